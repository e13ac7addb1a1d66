"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.naming import snake_cased
from .functions.text import collapsed, not_blank, trimmed_or_null
from .lab import Lab
from .operators.casting import is_json, strict
from .operators.constraints import Check, ConstraintError, Unique, duplicates, in_range, in_set, matches, orphans, violations
from .operators.merge import differs, latest, merge, newest
from .operators.project import conform, drop, empty_to_null
from .plans import bronze, checks, silver, stops
from .settings import Connection, parsed_env
from .sources import readers
from .sources.catalog import SOURCES
from .sources.spec import Source, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type, ts, value FROM events ORDER BY user_id, ts DESC NULLS FIRST, event_id")
def latest_event_per_user(spark, d):
    """The newest row of each key."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value")
    return newest(e, ["user_id"], "ts", F.col("event_id"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS FIRST, o_orderkey DESC")
def latest_order_per_customer(spark, d):
    """A4, O1 with a tie-break."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest(o, ["o_custkey"], [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()])


@query(r"SELECT doc_id, nullif(regexp_replace(trim(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), '') AS text FROM documents")
def clean_document_text(spark, d):
    """Trim, collapse white space, empty to null."""
    return t(spark, d, "documents").select("doc_id", collapsed(F.col("text")).alias("text"))


@query("SELECT c_custkey, upper(nullif(trim('  ' || lower(c_mktsegment) || ' '), '')) AS segment FROM customer")
def clean_segment_upper(spark, d):
    """Trim and upper."""
    padded = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return t(spark, d, "customer").select("c_custkey", F.upper(trimmed_or_null(padded)).alias("segment"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IS NOT NULL AND nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END), '') IS NOT NULL")
def non_blank_filter(spark, d):
    """key not null and text not blank."""
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text"))
    return t(spark, d, "documents").where(F.col("doc_id").isNotNull() & not_blank(text)).select("doc_id", "lang", "source")


@query(
    "WITH b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer) "
    "SELECT a.c_custkey, (a.c_name, a.c_acctbal, a.c_mktsegment) IS DISTINCT FROM (b.c_name, b.c_acctbal, b.c_mktsegment) AS changed FROM customer a JOIN b USING (c_custkey)"
)
def row_is_distinct(spark, d):
    """Null-safe comparison of rows."""
    a = t(spark, d, "customer")
    b = a.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"), F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("m"))
    changed = differs([F.col("c_name"), F.col("c_acctbal"), F.col("c_mktsegment")], [F.col("n"), F.col("x"), F.col("m")])
    return a.join(b, F.col("c_custkey") == F.col("k")).select("c_custkey", changed.alias("changed"))


@query("""
WITH old AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, 'old' AS record_source, DATE '2024-01-01' AS loaded_at FROM customer WHERE c_custkey % 10 < 8),
new AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 > 1),
j AS (SELECT old.c_custkey AS ok, new.c_custkey AS nk, old.c_name AS on_, new.c_name AS nn, old.c_acctbal AS ob, new.c_acctbal AS nb, old.c_mktsegment AS om, new.c_mktsegment AS nm, record_source, loaded_at,
  CASE WHEN old.c_custkey IS NULL THEN 'insert' WHEN new.c_custkey IS NULL THEN 'kept' WHEN (old.c_name, old.c_acctbal, old.c_mktsegment) IS DISTINCT FROM (new.c_name, new.c_acctbal, new.c_mktsegment) THEN 'update' ELSE 'unchanged' END AS action
  FROM old FULL OUTER JOIN new ON old.c_custkey = new.c_custkey)
SELECT coalesce(ok, nk) AS c_custkey, CASE WHEN action IN ('insert', 'update') THEN nn ELSE on_ END AS c_name, CASE WHEN action IN ('insert', 'update') THEN nb ELSE ob END AS c_acctbal,
  CASE WHEN action IN ('insert', 'update') THEN nm ELSE om END AS c_mktsegment, CASE WHEN action = 'insert' THEN 'new' ELSE record_source END AS record_source,
  CASE WHEN action IN ('insert', 'update') THEN DATE '2024-06-01' ELSE loaded_at END AS loaded_at, action FROM j
""")
def upsert_customer(spark, d):
    """Upsert with change detection; the stamp moves for added and changed rows only."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    old = c.where(k % 10 < 8).select("c_custkey", "c_name", F.when(k % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.lit("old").alias("record_source"), F.lit("2024-01-01").cast("date").alias("loaded_at"))
    return merge(old, c.where(k % 10 > 1), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], {"record_source": F.lit("new"), "loaded_at": F.lit("2024-06-01").cast("date")}, "action")


@query("SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderstatus AS has_vpa_flag, o_totalprice AS total_price2, o_orderpriority AS priority FROM orders")
def snake_case_headers(spark, d):
    """Renamed headers."""
    raw = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return raw.toDF(*snake_cased(["OrderKey", "customerKey", "HasVPAFlag", "TotalPrice2", " priority "]))


@query("SELECT p_partkey, nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, '') AS p_name, nullif(CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END, '') AS p_brand FROM part")
def empty_to_null_part(spark, d):
    """Empty text becomes null, blanks stay."""
    k = F.col("p_partkey")
    return empty_to_null(t(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("p_name"), F.when(k % 4 == 0, "").when(k % 5 == 0, " ").otherwise(F.col("p_brand")).alias("p_brand")))


@query("""
SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS INTEGER) AS as_int, CAST(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS DECIMAL(16, 2)) AS as_decimal,
  CAST(o_orderdate AS DATE) AS as_date, o_orderstatus = 'F' AS as_boolean FROM orders
""")
def typed_cast(spark, d):
    """Text back to whole numbers, decimals, dates and booleans."""
    o = t(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("i"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("b")
    )
    return o.select("o_orderkey", strict(F.col("i"), "int", "i").alias("as_int"), strict(F.col("n"), "decimal(16,2)", "n").alias("as_decimal"), strict(F.col("d"), "date", "d").alias("as_date"), strict(F.col("b"), "boolean", "b").alias("as_boolean"))


@query("""
SELECT 'not null l_orderkey' AS rule, count(*) FILTER (l_orderkey IS NULL) AS n FROM lineitem
UNION ALL SELECT 'not null l_discount', count(*) FILTER (nullif(l_discount, 0.05) IS NULL) FROM lineitem
UNION ALL SELECT 'check quantity', count(*) FILTER (NOT l_quantity BETWEEN 0 AND 23) FROM lineitem
UNION ALL SELECT 'check line', count(*) FILTER (nullif(l_linenumber, 7) NOT IN (1, 2, 3)) FROM lineitem
""")
def check_violations(spark, d):
    """broken rules, counted in one pass; null passes a check."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.nullif("l_discount", F.lit(0.05)).alias("l_discount"), F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber"))
    return violations(x, ["l_orderkey", "l_discount"], [Check("quantity", in_range("l_quantity", 0, 23)), Check("line", in_set("l_linenumber", 1, 2, 3))])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """F8: keys that occur more than once."""
    return duplicates(t(spark, d, "lineitem"), Unique("l_orderkey", "l_linenumber").columns)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 > 0)")
def orphan_report(spark, d):
    """References that lead nowhere."""
    return orphans(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").where("c_custkey % 9 > 0"), "o_custkey", "c_custkey")


def text_of(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string") for c in df.columns])


# -- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS doc_id, nullif(lang, '') AS lang, nullif(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN 'NA' WHEN doc_id % 3 = 1 THEN ' say \"hi\", \\n ' END AS note FROM documents")
def csv_scan(spark, d):
    """Every value as text from CSV with quoted line ends, quotes and commas; ``NA`` stays, empty fields are null."""
    k = F.col("doc_id") % 3
    raw = t(spark, d, "documents").select(F.col("doc_id").cast("string"), "lang", "text", F.when(k == 0, "NA").when(k == 1, ' say "hi", \\n ').alias("note"))
    return readers.read(spark, "csv", Lab(spark).csv("documents.csv", raw))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
def csv_lines_scan(spark, d):
    """The reader for large files without quoted line ends, which splits them among tasks."""
    raw = text_of(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return readers.read(spark, "csv_lines", Lab(spark).csv("orders.csv", raw))


@query("SELECT * FROM (VALUES ('1,2', true), ('1,2,3', false), ('1,2,', false), ('1', true), ('\"a,b\",2', true)) v(line, accepted)")
def csv_width(spark, d):
    """Short rows are filled, rows with more fields than the header fail, be the last ones empty."""
    lab, found = Lab(spark), []
    for k, line in enumerate(("1,2", "1,2,3", "1,2,", "1", '"a,b",2')):
        path = lab.lines(f"w{k}.csv", spark.createDataFrame([("a,b",), (line,)], "x string").coalesce(1), F.col("x"))
        try:
            found.append((line, readers.read(spark, "csv", path).count() == 1))
        except Exception as e:  # noqa: BLE001
            found.append((line, "more fields" not in str(e)))
    return spark.createDataFrame(found, "line string, accepted boolean")


@query("""
SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN '[1,"a b"]' END AS tags, CASE WHEN n_nationkey % 3 = 0 THEN '1.50' END AS extra, CASE WHEN n_nationkey % 5 > 0 THEN 'true' END AS flag,
  CASE WHEN n_nationkey % 4 > 0 THEN 'Point' END AS geometry_type, CASE WHEN n_nationkey % 4 > 0 THEN '{"type":"Point","coordinates":[' || n_nationkey || '.50,-33.0]}' END AS geometry FROM nation
""")
def geojson_scan(spark, d):
    """One row a feature; ragged properties, lists as JSON, numbers and geometry as they are spelt."""
    k, key = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    properties = F.concat(F.lit('"id": '), key, F.lit(', "name": "'), F.col("n_name"), F.lit('"'), F.when(k % 2 == 0, ', "tags": [1,  "a b"]').otherwise(""), F.when(k % 3 == 0, ', "extra": 1.50').otherwise(""), F.when(k % 5 > 0, ', "flag": true').otherwise(', "flag": null'))
    shape = F.when(k % 4 == 0, "null").otherwise(F.concat(F.lit('{ "type": "Point", "coordinates": ['), key, F.lit(".50, -33.0] }")))
    features = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"type": "Feature", "properties": {'), properties, F.lit('}, "geometry": '), shape, F.lit("}")).alias("f"))
    return readers.read(spark, "geojson", Lab(spark).document("nations.geojson", features, "n_nationkey", "f"))


@query("SELECT position, name FROM (VALUES (0, 'id'), (1, 'name'), (2, 'tags'), (3, 'extra'), (4, 'geometry_type'), (5, 'geometry')) v(position, name)")
def geojson_columns(spark, d):
    """The union of all property names, in the order of first sight."""
    made = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"properties": {"id": 1, "name": ""'), F.when(F.col("n_nationkey") > 3, ', "tags": "x"').otherwise(""), F.when(F.col("n_nationkey") > 7, ', "extra": 2').otherwise(""), F.lit("}}")).alias("f"))
    names = readers.read(spark, "geojson", Lab(spark).document("n.geojson", made, "n_nationkey", "f")).columns
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


@query("SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k') AS k, 'Point' AS geometry_type, '{\"type\":\"Point\",\"coordinates\":[' || user_id || ',1]}' AS geometry FROM events")
def geojson_lines_scan(spark, d):
    """A feature a line, split among tasks."""
    e = t(spark, d, "events")
    inner = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(", "), F.substring("props", 2, 1 << 30))
    line = F.concat(F.lit('{"type": "Feature", "properties": '), inner, F.lit(', "geometry": {"type": "Point", "coordinates": ['), F.col("user_id"), F.lit(", 1]}}"))
    return readers.read(spark, "geojson_lines", Lab(spark).lines("events.geojsonl", e, line))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_properties(spark, d):
    """Fields of JSON text, absent ones null."""
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def registered_reader(spark, d):
    """S3: a reader of one's own, by the name of its format."""
    readers.register("parquet_text")(lambda s, path: text_of(s.read.parquet(path)))
    return readers.read(spark, "parquet_text", f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("""SELECT k AS "key", v AS "value" FROM (VALUES ('LAB_A', 'x=1'), ('LAB_B', 'two words'), ('LAB_C', 'c'), ('dsn', 'postgresql://u+1:p%40ss@h:5432/postgres'), ('jdbc', 'jdbc:postgresql://h:5432/postgres')) x(k, v)""")
def settings_file(spark, d):
    """Settings from the lines of a file, and a connection in both forms."""
    found = parsed_env("# note\nLAB_A=x=1\n LAB_B = 'two words' # why\nexport LAB_C=c\nnothing\nLAB_A=again\n")
    c = Connection("postgres", "h", "5432", "postgres", "u 1", "p@ss")
    return spark.createDataFrame([*found.items(), ("dsn", c.url), ("jdbc", c.jdbc("t")["url"])], "key string, value string")


# -- bronze: files into tables ---------------------------------------------------------------------------------------

CUSTOMERS = table("demo", "customers", "customer_key int not null, customer_name text, acct_balance decimal(10,2), home_nation smallint, is_big boolean, since date, note text", [Unique("customer_key")], [Check("home_nation", in_range("home_nation", 0, 24))])
CUSTOMER_FILES = {n: Source(n, CUSTOMERS, f"raw/{n}.csv", "csv", drop=("spare", "not_there")) for n in ("even", "odd", "more")}
AT = datetime.datetime(2024, 5, 6, 7, 8, 9, tzinfo=datetime.timezone.utc)


def customer_file(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a raw file has them: other column order and names, one column to drop, all text."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("CustomerName"), k.cast("string").alias("CustomerKey"), F.lit("x").alias("Spare"), F.col("c_acctbal").cast("decimal(12,3)").cast("string").alias("AcctBalance"),
        F.col("c_nationkey").cast("string").alias("HomeNation"), F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").otherwise("").alias("IsBig"), F.when(k % 4 > 0, "2024-02-29").otherwise("").alias("Since"),
    )


def loaded_customers(spark: SparkSession, d: str) -> tuple[Lab, list[bronze.Loaded]]:
    """A lab whose table has the rows of two files."""
    lab, raw = Lab(spark), customer_file(spark, d)
    for n, rest in (("even", 0), ("odd", 1)):
        lab.csv(CUSTOMER_FILES[n].path, raw.where(F.col("CustomerKey").cast("int") % 2 == rest))
    return lab, bronze.run(lab.store, lab.data, ["even", "odd"], CUSTOMER_FILES, AT)


@query("""
SELECT c_custkey::INTEGER AS customer_key, c_name AS customer_name, c_acctbal::DECIMAL(10,2) AS acct_balance, c_nationkey::SMALLINT AS home_nation, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_big,
  CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-02-29' END AS since, NULL::VARCHAR AS note, CASE WHEN c_custkey % 2 = 0 THEN 'raw/even.csv' ELSE 'raw/odd.csv' END AS _source_file, 1714979289::BIGINT AS loaded_s FROM customer
""")
def bronze_load(spark, d):
    """Two declared files into one declared table, with lineage, read back."""
    lab, _ = loaded_customers(spark, d)
    return lab.store.read(CUSTOMERS).select(*[c.name for c in CUSTOMERS.columns], "_source_file", F.unix_timestamp("_loaded_at").alias("loaded_s"))


@query("SELECT 'demo.customers' AS \"table\", count(*) AS rows, CASE WHEN c_custkey % 2 = 0 THEN 'raw/even.csv' ELSE 'raw/odd.csv' END AS source FROM customer GROUP BY 3")
def load_report(spark, d):
    """K6, A3: what each load has put where."""
    return bronze.report(spark, loaded_customers(spark, d)[1])


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'raw/even.csv' ELSE 'raw/odd.csv' END AS source, 1::BIGINT AS times, true AS in_run FROM customer GROUP BY 1")
def default_timestamp(spark, d):
    """Rows of a load share one time, by default that of the load."""
    lab, _ = loaded_customers(spark, d)
    began = datetime.datetime.now(datetime.timezone.utc)
    bronze.run(lab.store, lab.data, ["even", "odd"], CUSTOMER_FILES)
    ended = datetime.datetime.now(datetime.timezone.utc)
    inside = F.bool_and(F.col("_loaded_at").between(F.lit(began), F.lit(ended)))
    return lab.store.read(CUSTOMERS).groupBy(F.col("_source_file").alias("source")).agg(F.count_distinct("_loaded_at").alias("times"), inside.alias("in_run"))


@query("SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_phone, s_nationkey::INTEGER AS s_nationkey, 'raw/supplier.csv' AS _source_file FROM supplier")
def drop_and_pad_columns(spark, d):
    """Columns dropped, absent ones passed over or padded, in table order, with the file on each row."""
    goal = table("demo", "supplier", "s_suppkey bigint, s_name text, s_phone text, s_nationkey int")
    return conform(drop(text_of(t(spark, d, "supplier")), ("s_acctbal", "not_there")), goal, "raw/supplier.csv", None).drop("_loaded_at")


@query("SELECT c_custkey::INTEGER AS customer_key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) || '!' END AS customer_name, CASE WHEN c_custkey % 2 = 0 THEN 'raw/even.csv' ELSE 'raw/odd.csv' END AS _source_file FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def replace_source(spark, d):
    """The rows of one file replaced as a whole, those of the other untouched."""
    lab, _ = loaded_customers(spark, d)
    again = customer_file(spark, d).where("CustomerKey % 2 = 1 AND CustomerKey % 3 = 0").withColumn("CustomerName", F.concat(F.upper("CustomerName"), F.lit("!")))
    lab.csv(CUSTOMER_FILES["odd"].path, again)
    bronze.run(lab.store, lab.data, ["odd"], CUSTOMER_FILES)
    return lab.store.read(CUSTOMERS).select("customer_key", "customer_name", "_source_file")


@query("SELECT c_custkey::INTEGER AS customer_key FROM customer WHERE c_custkey % 2 = 1")
def delete_source(spark, d):
    """K3: the rows of one file go."""
    lab, _ = loaded_customers(spark, d)
    lab.store.remove(CUSTOMERS, CUSTOMER_FILES["even"].path)
    return lab.store.read(CUSTOMERS).select("customer_key")


@query("SELECT 'even' AS file, count(*) FILTER (c_custkey % 2 = 0) AS n, NULL::VARCHAR AS refused FROM customer UNION ALL SELECT 'odd', count(*) FILTER (c_custkey % 2 = 1), 'unique (customer_key)' FROM customer UNION ALL SELECT 'more', 0, 'unique (customer_key)'")
def failed_load_keeps_rows(spark, d):
    """K4, F8: a file with a key twice, or with a key of another file, is refused; the old rows stay."""
    lab, _ = loaded_customers(spark, d)
    raw, refused = customer_file(spark, d), {}
    odd = raw.where("CustomerKey % 2 = 1")
    for name, rows in (("odd", odd.unionByName(odd)), ("more", raw.where("CustomerKey % 2 = 0"))):
        lab.csv(CUSTOMER_FILES[name].path, rows)
        try:
            bronze.load(lab.store, CUSTOMER_FILES[name], lab.data)
        except ConstraintError as e:
            refused[name] = str(e).partition(":")[0]
    rows = [(n, lab.store.read(CUSTOMERS, s.path).count(), refused.get(n)) for n, s in CUSTOMER_FILES.items()]
    return spark.createDataFrame(rows, "file string, n long, refused string")


@query("SELECT * FROM (VALUES (1::BIGINT, true, true, 'customer_key int, note string'), (1::BIGINT, true, true, 'customer_key int, note string')) v(versions, there, bare, columns)")
def create_if_absent(spark, d):
    """A table is made once, from its declaration, and is empty."""
    lab, found = Lab(spark), []
    for _ in range(2):
        lab.store.create(CUSTOMERS)
        df = lab.store.read(CUSTOMERS)
        found.append((len(lab.store.versions(CUSTOMERS)), lab.store.exists(CUSTOMERS), df.isEmpty(), ", ".join(f"{n} {k}" for n, k in df.dtypes if n in ("customer_key", "note"))))
    return spark.createDataFrame(found, "versions long, there boolean, bare boolean, columns string")


REGIONS = table("demo", "regions", "_row_id bigint identity, r_regionkey int not null, r_name text", [Unique("_row_id"), Unique("r_regionkey")])


@query("SELECT r_regionkey, r_name, true AS above, 1::BIGINT AS times FROM region")
def identity_rows(spark, d):
    """Numbers are unique and above all that were given before, also when the same file is loaded again."""
    lab, source = Lab(spark), Source("regions", REGIONS, "raw/region.csv", "csv")
    lab.csv(source.path, text_of(t(spark, d, "region").select("r_regionkey", "r_name")))
    bronze.load(lab.store, source, lab.data)
    top = lab.store.read(REGIONS).agg(F.max("_row_id")).first()[0]
    bronze.load(lab.store, source, lab.data)
    rows = lab.store.read(REGIONS)
    times = rows.groupBy("_row_id").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(times, "_row_id").select("r_regionkey", "r_name", (F.col("_row_id") > top).alias("above"), "times")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'raw/even.csv' ELSE 'raw/odd.csv' END AS source, true AS in_order, count(*) AS n FROM customer GROUP BY 1")
def sorted_parts(spark, d):
    """O2: the files of a part are sorted by the table's key, for row groups to be skipped."""
    lab, _ = loaded_customers(spark, d)
    rows = lab.store.read(CUSTOMERS).select("_source_file", "customer_key", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("customer_key").over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("ok", F.coalesce(before <= F.col("customer_key"), F.lit(True))).groupBy(F.col("_source_file").alias("source")).agg(F.bool_and("ok").alias("in_order"), F.count(F.lit(1)).alias("n"))


# -- selection and checks --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('none', 0, 'even', true), ('none', 1, 'odd', true), ('none', 2, 'more', true), ('some', 0, 'odd', true), ('some', 1, 'even', true), ('odd one', 0, 'nope', false), ('odd one', 1, 'gone', false)) v(selection, position, name, known)")
def source_selection(spark, d):
    """No selection is all sources; a selection keeps its order; unknown names are told."""
    rows = []
    for what, names in (("none", []), ("some", ["odd", "even"]), ("odd one", ["nope", "even", "gone"])):
        try:
            rows += [(what, k, n, True) for k, n in enumerate(bronze.chosen(names, CUSTOMER_FILES))]
        except bronze.UnknownSources as e:
            rows += [(what, k, n, False) for k, n in enumerate(e.names)]
    return spark.createDataFrame(rows, "selection string, position int, name string, known boolean")


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS even, count(*) FILTER (c_custkey % 2 = 1) AS odd, 0::BIGINT AS more FROM customer")
def count_one_source(spark, d):
    """A1, F1: rows of one source file, from its part alone."""
    lab, _ = loaded_customers(spark, d)
    return spark.createDataFrame([tuple(lab.store.read(CUSTOMERS, s.path).count() for s in CUSTOMER_FILES.values())], "even long, odd long, more long")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """even is complete, odd's file has lost rows since, more has no file, other has no table."""
    lab, _ = loaded_customers(spark, d)
    raw = customer_file(spark, d)
    lab.csv(CUSTOMER_FILES["odd"].path, raw.where("CustomerKey % 2 = 1 AND CustomerKey % 5 > 0"))
    lab.csv("raw/other.csv", raw)
    other = Source("other", REGIONS, "raw/other.csv", "csv")
    return checks.completeness(lab.store, lab.data, None, CUSTOMER_FILES | {"other": other})


@query("""
WITH n AS (SELECT count(*) FILTER (c_custkey % 2 = 0) AS e, count(*) FILTER (c_custkey % 2 = 1) AS o, count(*) FILTER (c_custkey % 2 = 1 AND c_custkey % 5 > 0) AS f FROM customer)
SELECT 'even' AS source, 'complete' AS status, e AS in_table, e AS in_file, 0::BIGINT AS difference, true AS ok FROM n
UNION ALL SELECT 'odd', CASE WHEN o = f THEN 'complete' ELSE 'differs' END, o, f, o - f, o = f FROM n UNION ALL SELECT 'more', 'file missing', NULL, NULL, NULL, false UNION ALL SELECT 'other', 'table missing', NULL, NULL, NULL, false
""")
def completeness_report(spark, d):
    """Rows in files against rows in tables, with a signed difference; what is missing is told."""
    return _checked(spark, d).drop("table")


@query("SELECT 3::BIGINT AS failed, false AS complete")
def completeness_tally(spark, d):
    """A5: how many sources fail, and whether all are complete."""
    return spark.createDataFrame([checks.tally(_checked(spark, d))], "failed long, complete boolean")


@query("""
WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src7' AND (source <> 'src3' OR doc_id % 2 = 0) GROUP BY source)
SELECT a.source, a.n AS in_file, coalesce(b.n, 0) AS in_table, coalesce(b.n, 0) - a.n AS difference, coalesce(b.n, 0) = a.n AS ok FROM a LEFT JOIN b USING (source)
""")
def compared_counts(spark, d):
    """Two tables of counts compared, with a signed difference."""
    x = t(spark, d, "documents").select("source", "doc_id")
    there = x.where("source <> 'src7' AND (source <> 'src3' OR doc_id % 2 = 0)")
    count = lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return checks.compared(count(x), count(there))


# -- silver ----------------------------------------------------------------------------------------------------------


def _schools(spark: SparkSession, d: str, name) -> tuple[Lab, DataFrame]:
    """Suppliers as raw schools, loaded into bronze."""
    lab, k = Lab(spark), F.col("s_suppkey")
    raw = t(spark, d, "supplier").select(
        k.cast("string").alias("school_code"), F.when(k % 7 == 0, "  ").otherwise(name).alias("school_name"), F.when(k % 3 == 0, " 1   Main\tSt ").when(k % 3 == 1, "\t").alias("street"),
        F.when(k % 2 == 0, F.concat(F.lit(" town "), (k % 5).cast("string"))).alias("town_suburb"), F.when(k % 4 > 0, F.concat(F.lit(" "), (2000 + k % 1000).cast("string"), F.lit(" "))).otherwise(" ").alias("postcode"),
    )
    lab.csv(SOURCES["school_location"].path, raw)
    return lab, raw


_SCHOOL_SQL = """
SELECT s_suppkey::INTEGER AS school_code, trim({name}) AS school_name, CASE s_suppkey % 3 WHEN 0 THEN '1 Main St' WHEN 1 THEN ' ' END AS street, CASE WHEN s_suppkey % 2 = 0 THEN 'TOWN ' || (s_suppkey % 5) END AS town_suburb,
  CASE WHEN s_suppkey % 4 > 0 THEN (2000 + s_suppkey % 1000)::VARCHAR END AS postcode FROM supplier WHERE s_suppkey % 7 > 0
"""


@query(_SCHOOL_SQL.format(name="s_name"))
def silver_projection(spark, d):
    """From a loaded table to cleaned columns, one row a key."""
    lab, _ = _schools(spark, d, F.col("s_name"))
    bronze.run(lab.store, lab.data, ["school_location"])
    return silver.cleaned(lab.store.read(SOURCES["school_location"].table))


@query("SELECT count(*) AS silver_rows FROM supplier WHERE s_suppkey % 7 > 0")
def silver_count(spark, d):
    """A2, K2: rows of the entity after it was built."""
    lab, _ = _schools(spark, d, F.col("s_name"))
    bronze.run(lab.store, lab.data, ["school_location"])
    silver.build_schools(lab.store, AT)
    return silver.entity(lab.store).agg(F.count(F.lit(1)).alias("silver_rows"))


@query(f"SELECT *, 'NSW_DOE_SCHOOL_LOCATIONS' AS record_source, CASE WHEN school_name LIKE '%!' THEN 1717200000 ELSE 1714979289 END::BIGINT AS loaded_s FROM ({_SCHOOL_SQL.format(name=chr(39) + 'N' + chr(39) + ' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN ' + chr(39) + '!' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END')})")
def silver_upsert(spark, d):
    """Built twice; the time of a row moves only where its values have changed."""
    plain = F.concat(F.lit("N"), F.col("s_suppkey").cast("string"))
    lab, _ = _schools(spark, d, plain)
    bronze.run(lab.store, lab.data, ["school_location"])
    silver.build_schools(lab.store, AT)
    again, _ = _schools(spark, d, F.concat(plain, F.when(F.col("s_suppkey") % 5 == 0, "!").otherwise("")))
    bronze.run(lab.store, again.data, ["school_location"])
    silver.build_schools(lab.store, datetime.datetime(2024, 6, 1, tzinfo=datetime.timezone.utc))
    return silver.entity(lab.store).withColumn("loaded_s", F.unix_timestamp("loaded_at")).drop("loaded_at")


# -- values ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, regexp_full_match(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || chr(10) END, 'NATION_[0-9]+') AS ok FROM nation")
def regex_check(spark, d):
    """The whole value matches, a trailing line end doesn't pass."""
    n = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("\n"))).alias("n_name"))
    return n.select("n_nationkey", matches("n_name", "NATION_[0-9]+")().alias("ok"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN lpad((c_custkey % 10000)::VARCHAR, (c_custkey % 3 + 2)::INTEGER, '0') || '  ' END AS code FROM customer WHERE length((c_custkey % 10000)::VARCHAR) <= 3")
def char_cast(spark, d):
    """Text of at most four characters; spaces at its end don't count."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").where(F.length((k % 10000).cast("string")) <= 3)
    text = F.when(k % 3 > 0, F.concat(F.lpad((k % 10000).cast("string"), (k % 3 + 2).cast("int"), F.lit("0")), F.lit("  ")))
    return c.select("c_custkey", strict(text, "char(4)", "code").alias("code"))


@query("SELECT * FROM (VALUES ('char(4)', '20000', false), ('char(4)', '2000 ', true), ('int', '1.0', false), ('int', ' 7 ', true), ('date', '2024', false), ('date', '2024-02-30', false), ('boolean', 'maybe', false), ('decimal(5,2)', '1000', false), ('decimal(5,2)', '1.005', true), ('json', '{\"a\":', false), ('json', '[1]', true)) v(kind, value, accepted)")
def strict_casts(spark, d):
    """One bad value stops the load."""
    found = []
    for kind, value in (("char(4)", "20000"), ("char(4)", "2000 "), ("int", "1.0"), ("int", " 7 "), ("date", "2024"), ("date", "2024-02-30"), ("boolean", "maybe"), ("decimal(5,2)", "1000"), ("decimal(5,2)", "1.005"), ("json", '{"a":'), ("json", "[1]")):
        try:
            spark.createDataFrame([(value,)], "v string").select(strict(F.col("v"), kind, "v").alias("v")).collect()
            found.append((kind, value, True))
        except Exception:  # noqa: BLE001
            found.append((kind, value, False))
    return spark.createDataFrame(found, "kind string, value string, accepted boolean")


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN left(props, -1) ELSE props END) AS ok, CASE WHEN event_id % 3 > 0 THEN '{\"b\":' || replace(props, ' ', '') || ',\"a\":[1.50,\"x  y\"]}' END AS bare FROM events")
def json_text(spark, d):
    """JSON told from other text, and JSON without white space between tokens; keys and numbers stay as they are."""
    k = F.col("event_id")
    cut = F.when(k % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    loose = F.when(k % 3 > 0, F.concat(F.lit('{ "b" : '), F.col("props"), F.lit(' ,\n "a": [1.50, "x  y"] }')))
    return t(spark, d, "events").select("event_id", is_json(cut).alias("ok"), readers.bare_json(loose).alias("bare"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_nationkey::VARCHAR ELSE '[\"' || c_name || '\",null]' END AS v FROM customer")
def value_to_text(spark, d):
    """Strings as they are, numbers as they are spelt, lists as JSON, null as null."""
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))).when(k % 3 == 1, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit('["'), F.col("c_name"), F.lit('", null]')))
    line = F.concat(F.lit('{"properties": {"c_custkey": '), k, F.lit(', "v": '), v, F.lit("}}"))
    rows = readers.read(spark, "geojson_lines", Lab(spark).lines("v.geojsonl", t(spark, d, "customer"), line))
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "v")


@query("""
WITH a AS (SELECT c_custkey::INTEGER AS school_code, -33.5 - (c_custkey % 97) / 500.0 AS y, 151 + (c_custkey % 89) / 500.0 AS x FROM customer),
b AS (SELECT s_suppkey::INTEGER AS stop_id, -33.5 - (s_suppkey % 83) / 430.0 AS lat, 151 + (s_suppkey % 79) / 430.0 AS lon FROM supplier),
m AS (SELECT school_code, stop_id, 2 * 6371008.8 * asin(sqrt(least(1, sin(radians(lat - y) / 2) ** 2 + cos(radians(y)) * cos(radians(lat)) * sin(radians(lon - x) / 2) ** 2))) AS d FROM a, b)
SELECT school_code, arg_min(stop_id, (d, stop_id)) FILTER (d <= 2000) AS nearest_stop_id, round(min(d) FILTER (d <= 2000), 3) AS nearest_m, count(*) FILTER (d <= 300) AS n_within FROM m GROUP BY school_code
""")
def stops_near_schools(spark, d):
    """The nearest stop and the number of stops around, by grid cells."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = t(spark, d, "customer").select(k.cast("int").alias("school_code"), (F.lit(-33.5) - (k % 97) / 500.0).alias("latitude"), (F.lit(151.0) + (k % 89) / 500.0).alias("longitude"))
    b = t(spark, d, "supplier").select(s.cast("int").alias("stop_id"), (F.lit(-33.5) - (s % 83) / 430.0).alias("lat"), (F.lit(151.0) + (s % 79) / 430.0).alias("lon"))
    return stops.near(a, b).withColumn("nearest_m", F.round("nearest_m", 3))
