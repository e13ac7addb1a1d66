"""The queries of the text operators, one ``opN_<name>`` each, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, licences, pieces, pii, quality, sharding, simhash, urls, vecdedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query (action, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.fit(urls.labelled_urls(spark)))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1: host, path, and the rule that fits."""
    split = _table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rule, action = urls.rule_of(F.col("host"), F.col("path"), URL_RULES)
    return split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_decontamination, op3_sharding, op4_lm_scoring, op5_sentencepiece, op6_quality_classifier, op7_pii, op8_simhash, op9_license_scan, op10_embedding_dedup, url_rules)}


OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM doc),
hit AS (
  SELECT spot.r, spot.k, sizes.n, array_to_string(spot.w[spot.k:spot.k + sizes.n - 1], ' ') AS s
  FROM spot, sizes WHERE spot.k + sizes.n - 1 <= len(spot.w)),
found AS (SELECT hit.r, hit.k, hit.n, win.item_id FROM hit JOIN win ON hit.s = win.s AND hit.n = win.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def _op9_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, *(x.replace("'", "''") for x in t)) for k, t in enumerate(sorted(licences.TEMPLATES)))
    words = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    joined = "list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])"
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, {joined} AS b FROM (SELECT r, {words.format("text")} AS w FROM doc) WHERE len(w) > 1),
t AS (SELECT k, name, list_distinct({joined}) AS t, len(list_distinct({joined})) AS n, len(w) - 1 AS width, greatest(1, len(w) // 8) AS step FROM (SELECT k, name, {words.format("body")} AS w FROM (VALUES {rows}) v(k, name, body))),
pair AS (SELECT r, k, greatest(len(b) - width, 0) AS last FROM (SELECT r, k, b, t, n, width FROM (SELECT r, b, list_distinct(b) AS d FROM b) x, t WHERE 3 * len(list_intersect(t, d)) >= 2 * n)),
win AS (SELECT r, k, least(unnest(range(0, ceil(last / step)::BIGINT + 1)) * step, last) AS start FROM pair JOIN t USING (k)),
scored AS (SELECT r, k, name, n, start, start + least(width, len(b)) + 1 AS stop, 2 * len(list_intersect(t, list_distinct(b[start + 1:start + width]))) / (len(list_distinct(b[start + 1:start + width])) + n) AS dice FROM win JOIN b USING (r) JOIN t USING (k)),
best AS (SELECT DISTINCT ON (r, k) * FROM scored ORDER BY r, k, dice DESC, start),
good AS (SELECT * FROM best WHERE dice >= 0.8),
hit AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.r = g.r AND o.start < g.stop AND g.start < o.stop AND (o.dice > g.dice OR o.dice = g.dice AND (o.n > g.n OR o.n = g.n AND o.k < g.k)))),
top AS (SELECT DISTINCT ON (r) r, name AS licence, dice FROM hit ORDER BY r, dice DESC, n DESC, k),
every AS (SELECT r, count(*) AS n, array_to_string(list_sort(list(DISTINCT name)), ',') AS licences FROM hit GROUP BY r)
SELECT doc_id, licence, coalesce(round(dice, 6), 0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences FROM doc LEFT JOIN top USING (r) LEFT JOIN every USING (r)
"""


def _rules_sql() -> str:
    rows = ", ".join(f"('{act}', '{h}', '{p}')" for act, h, p in URL_RULES)
    return rf"""
WITH split AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
fits AS (SELECT DISTINCT ON (r) r, h || p AS rule, act AS action FROM split, (VALUES {rows}) v(act, h, p) WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) ORDER BY r, length(h || p) DESC)
SELECT page_id, host, path, rule, action FROM split LEFT JOIN fits USING (r)
"""


OP10_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y FROM fine a, fine b WHERE a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, link.y FROM reach JOIN link ON reach.s = link.x),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
n AS (SELECT x AS r, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least USING (r) LEFT JOIN n USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"url_rules": _rules_sql(), "op2_decontamination": OP2_SQL, "op9_license_scan": _op9_sql(), "op10_embedding_dedup": OP10_SQL}
