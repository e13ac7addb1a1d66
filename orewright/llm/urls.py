"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest. Built-in functions only.

Features: length, depth, digit ratio, host entropy, parameter count, host labels, hyphens, query length, and for the last
one, two and three labels of the host the smoothed rate and the count of label 1 among the training URLs (a URL's own label
left out while training).

Training reads at most about ``sample_rows`` labelled URLs, chosen by hash. Trees grow level by level: one aggregation gives
the gradient sums of every (node, feature, bin), at most 2 ** depth * features * bins rows, from which the driver picks the
splits. Trees are then plain CASE expressions, so scoring is one projection inside generated code. The suffix table has three
rows a training URL at most and is broadcast on that bound.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and the model's verdict on an empty
URL; without labelled URLs of both kinds every score is the share of label 1 (0 if there are none); null labels are no
labels; repeated rows each get their verdict; an empty table gives an empty table; a long URL is read whole.
``labelled_urls`` generates a training table for where there is no better one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

Rule = tuple[str, str, str]  # action, host, path


@dataclass(frozen=True)
class Plan:
    sample_rows: int = 20_000
    trees: int = 10
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    smooth: float = 1.0
    prior_weight: float = 5.0
    threshold: float = 0.5


@dataclass
class Model:
    base: float
    trees: list[dict] = field(default_factory=list)
    suffixes: DataFrame | None = None
    share: float = 0.0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = (1, 2, 3)
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_query", *(f"f_{what}{k}" for k in SUFFIXES for what in ("rate", "seen"))]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none does. Rules are configuration, not data."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: join a rule table instead")
    text = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, h + p).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


def entropy(text: Column) -> Column:
    """Bits per character, from the lengths of runs among the sorted characters: linear but for the sort."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    size = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    step = lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + size(a["run"])).alias("sum")))
    n = F.length(text).cast("double")
    total = F.aggregate(chars, start, step, lambda a: a["sum"] + size(a["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def count_of(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``df`` with the features that need no training."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(u, "[^0-9]", "")).cast("double")
    return df.withColumns({
        "f_length": F.length(u).cast("double"),
        "f_depth": F.size(F.filter(F.split(F.col(path), "/"), lambda s: s != "")).cast("double"),
        "f_digits": digits / F.greatest(F.length(u), F.lit(1)),
        "f_entropy": entropy(F.col(host)),
        "f_params": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1),
        "f_labels": F.when(F.col(host) == "", 0.0).otherwise(count_of(F.col(host), ".") + 1),
        "f_hyphens": count_of(F.col(host), "-"),
        "f_query": F.length(query).cast("double"),
    } | {f"s_{k}": F.concat(F.lit(f"{k}:"), F.substring_index(F.col(host), ".", -k)) for k in SUFFIXES})


def with_suffixes(df: DataFrame, suffixes: DataFrame, plan: Plan, share: float, own: str | None = None) -> DataFrame:
    """``df`` with rate and count of each suffix; ``own`` names the row's label, which is left out."""
    for k in SUFFIXES:
        part = suffixes.select(F.col("suffix").alias(f"s_{k}"), F.col("n").alias(f"n_{k}"), F.col("ones").alias(f"o_{k}"))
        df = df.join(F.broadcast(part), f"s_{k}", "left")  # 3 * sample_rows rows at most
        n, ones = F.coalesce(F.col(f"n_{k}"), F.lit(0)) - (1 if own else 0), F.coalesce(F.col(f"o_{k}"), F.lit(0)) - (F.col(own) if own else 0)
        df = df.withColumns({f"f_rate{k}": (ones + plan.prior_weight * share) / (n + plan.prior_weight), f"f_seen{k}": F.log1p(n.cast("double"))}).drop(f"n_{k}", f"o_{k}")
    return df


def tree_expression(tree: dict, leaf) -> Column:
    if "feature" not in tree:
        return leaf(tree)
    return F.when(F.col(tree["feature"]) <= tree["edge"], tree_expression(tree["left"], leaf)).otherwise(tree_expression(tree["right"], leaf))


def raw_score(model: Model) -> Column:
    total = F.lit(model.base)
    for tree in model.trees:
        total = total + tree_expression(tree, lambda t: F.lit(float(t["value"])))
    return total


def fit(labelled: DataFrame, url: str = "url", label: str = "label", plan: Plan = Plan()) -> Model:
    """Boosted trees on labelled URLs (label 0 or 1)."""
    scratch = Scratch(labelled.sparkSession)
    known = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("y"))
    n = known.count()
    if n > plan.sample_rows:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * plan.sample_rows / n))
    split = known.select("url", "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sample = scratch.save(lexical(split, "url", "host", "path").drop("url", "host", "path").coalesce(4))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = ones / n if n else 0.0
    suffixes = sample.select("y", F.explode(F.array(*[f"s_{k}" for k in SUFFIXES])).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    suffixes = scratch.save(suffixes.coalesce(1))
    if not 0 < ones < n:
        return Model(math.log(max(share, 1e-6) / max(1 - share, 1e-6)), [], suffixes, share)
    rows = scratch.save(with_suffixes(sample, suffixes, plan, share, own="y").select("y", *FEATURES).coalesce(4))
    shares = [k / plan.bins for k in range(1, plan.bins)]
    edges = [sorted(set(e)) for e in rows.agg(*[F.percentile_approx(f, shares, 2000).alias(f) for f in FEATURES]).first()]
    places = F.array(*[sum((F.when(F.col(f) > e, 1).otherwise(0) for e in cut), F.lit(0)) for f, cut in zip(FEATURES, edges)])
    binned = scratch.save(rows.withColumn("bins", places).coalesce(4))
    model = Model(math.log(share / (1 - share)), [], suffixes, share)
    gain = lambda g, h: g * g / (h + plan.smooth)
    for _ in range(plan.trees):
        p = 1 / (1 + F.exp(-raw_score(model)))
        graded = binned.select("bins", *FEATURES, (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        tree: dict = {"id": 0}
        leaves = [tree]
        for _ in range(plan.depth):
            at = tree_expression(tree, lambda t: F.lit(t["id"]))
            sums = graded.select(at.alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            table: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
            for r in sums:
                table.setdefault((r.node, r.f), {})[r.bin] = (r.g, r.h)
            grown = []
            for node in leaves:
                best = (1e-6, None)
                for f, cut in enumerate(edges):
                    own = table.get((node["id"], f), {})
                    g, h = sum(x for x, _ in own.values()), sum(x for _, x in own.values())
                    node["value"] = -plan.rate * g / (h + plan.smooth) if own else 0.0
                    left_g = left_h = 0.0
                    for b, edge in enumerate(cut):
                        left_g, left_h = left_g + own.get(b, (0, 0))[0], left_h + own.get(b, (0, 0))[1]
                        won = gain(left_g, left_h) + gain(g - left_g, h - left_h) - gain(g, h)
                        if min(left_h, h - left_h) > 1e-3 and won > best[0]:
                            best = (won, (f, edge, left_g, left_h, g - left_g, h - left_h))
                if best[1]:
                    f, edge, *half = best[1]
                    kids = [{"id": 2 * node["id"] + 1 + k, "value": -plan.rate * half[2 * k] / (half[2 * k + 1] + plan.smooth)} for k in range(2)]
                    node.update(feature=FEATURES[f], edge=float(edge), left=kids[0], right=kids[1])
                    grown += kids
            leaves = grown
            if not leaves:
                break
        model.trees.append(tree)
    scratch.drop(sample, rows, binned)
    return model


def score(df: DataFrame, model: Model, url: str, host: str, path: str, name: str = "score", plan: Plan = Plan()) -> DataFrame:
    """``df`` with the model's probability of label 1, which replaces a column of its name; all others stay as they are."""
    columns = [c for c in df.columns if c != name]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    inner = df.toDF(*[f"c{k}" for k in range(len(columns))])
    at = lambda c: f"c{columns.index(c)}"
    ready = with_suffixes(lexical(inner, at(url), at(host), at(path)), model.suffixes, plan, model.share)
    chance = 1 / (1 + F.exp(-raw_score(model)))
    if not model.trees:
        chance = F.lit(model.share)
    return ready.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], chance.cast("double").alias(name))


def judge(pages: DataFrame, rules: list[Rule], model: Model, page_id: str = "page_id", url: str = "url", plan: Plan = Plan()) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    split = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    said = F.when(F.col("score") >= plan.threshold, "block").otherwise("allow")
    return score(split, model, "url", "host", "path", plan=plan).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, said).alias("verdict"), "score")


#: What the generated training URLs are made of.
PLAIN = ("news", "garden", "museum", "river", "school", "music", "health", "travel", "market", "library", "science", "photo", "sport", "forum", "recipe", "weather", "history", "design", "local", "nature")
BAIT = ("secure", "login", "account", "verify", "update", "free", "bonus", "prize", "cheap", "deal", "win", "cash", "click", "offer", "best", "online")
GOOD_ENDS, BAD_ENDS = ("com", "org", "net", "edu", "de", "fr", "es", "co.uk"), ("com", "net", "info", "xyz", "top", "click", "ru", "biz")


def labelled_urls(spark: SparkSession, rows: int = 20_000, seed: int = 1) -> DataFrame:
    """(url, label): generated URLs, half of them (label 1) in the forms that studies of unwanted and malicious sites describe:
    hyphenated and random hosts, bare addresses, deep subdomains, long paths and many parameters. Every tenth URL of either
    kind has the host of the other, so nothing gives the label away. Fixed by the seed."""
    draw = lambda what: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(1 << 30))
    share = lambda what: draw(what) / float(1 << 30)
    one = lambda what, of: F.element_at(F.array(*map(F.lit, of)), (draw(what) % len(of) + 1).cast("int"))
    noise = lambda what, n: F.substring(F.sha2(draw(what).cast("string"), 256), 1, n)
    odd = lambda what, p, text, rest="": F.when(share(what) < p, text).otherwise(rest)
    lead = F.when(share("lead") < 0.25, "www.").when(share("lead") < 0.35, "m.").when(share("lead") < 0.45, "blog.").otherwise("")
    good_host = F.concat(lead, one("a", PLAIN), odd("two", 0.4, one("b", PLAIN)), odd("dash", 0.03, F.concat(F.lit("-"), one("c", PLAIN))), odd("site", 0.3, F.concat(F.lit("."), one("d", PLAIN))), F.lit("."), one("end", GOOD_ENDS))
    compound = F.concat(odd("sub", 0.3, lead), one("e", (*BAIT, *PLAIN)), F.lit("-"), one("f", (*BAIT, *PLAIN)), odd("third", 0.3, F.concat(F.lit("-"), one("g", BAIT))), odd("digits", 0.2, (draw("h") % 1000).cast("string")), odd("under", 0.3, F.concat(F.lit("."), one("i", PLAIN))))
    random = F.concat(noise("j", 9), odd("more", 0.5, noise("k", 7)))
    deep = F.concat_ws(".", one("l", BAIT), one("m", BAIT), noise("n", 6), one("o", PLAIN))
    address = F.concat_ws(".", *[(draw(x) % 223 + 1).cast("string") for x in "pqrs"])
    bad_name = F.concat(F.when(share("kind") < 0.6, compound).when(share("kind") < 0.8, random).otherwise(deep), F.lit("."), one("t", BAD_ENDS))
    bad_host = F.when(share("ip") < 0.08, address).otherwise(bad_name)
    good_path = F.concat(F.lit("/"), one("u", ("en", "de", "fr", "es", "about", "post", "2021/04")), F.lit("/"), (draw("v") % 1000).cast("string"), odd("html", 0.2, F.lit(".html")), odd("slash", 0.2, F.lit("/")), odd("par", 0.25, F.lit("?page=2&ref=x")), odd("utm", 0.1, F.lit("?utm_source=feed")), odd("top", 0.15, F.lit("#top")))
    bad_path = F.concat(F.lit("/"), one("w", BAIT), odd("deeper", 0.4, F.concat(F.lit("/"), noise("x", 12))), odd("php", 0.4, F.lit(".php")), odd("q", 0.4, F.concat(F.lit("?id="), noise("y", 16), F.lit("&s="), draw("z").cast("string"), F.lit("&r=1"))))
    label = (draw("label") % 2 == 1).cast("int")
    swapped = share("swap") < 0.1
    host = F.when((F.col("label") == 1) != swapped, bad_host).otherwise(good_host)
    path = F.when((F.col("label") == 1) & (share("path") < 0.5), bad_path).otherwise(good_path)
    made = spark.range(rows).withColumn("label", label)
    return made.select(F.concat(F.when(share("tls") < 0.6, "https://").otherwise("http://"), host, path).alias("url"), "label")
