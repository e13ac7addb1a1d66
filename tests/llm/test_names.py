from __future__ import annotations

from pyspark.sql import functions as F

from orewright.llm import decontaminate, nearcopies, pieces, quality, simhash, urls

NAMES = ["n_words", "n_hit", "items", "places", "score", "fp", "node", "fa", "row", "size", "bands", "label", "__text"]


def odd(spark):
    """Documents with columns of the names that the operators use themselves."""
    rows = [(1, "one two three four five six seven", "http://a.net/x"), (2, "one two three four five six seven", "b"), (3, None, None), (4, "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, url string").select("*", *[F.lit(7).alias(n) for n in NAMES])


def test_operators_bear_columns_with_their_own_names(spark):
    df = odd(spark)
    bench = spark.createDataFrame([("i", "one two three four five six seven")], "item_id string, text string")
    assert decontaminate.clean(df, bench).columns == df.columns and decontaminate.clean(df, bench).count() == 2
    marked = decontaminate.mark(df.drop("__text"), bench)
    assert len(marked.columns) == len(set(marked.columns)) and marked.where("n_hit = 7").count() == 2
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
    prints = simhash.fingerprints(df.drop("__text"))
    assert len(prints.columns) == len(set(prints.columns)) and prints.count() == 4
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.keep_good(df, labels).columns == df.columns
    scored = quality.score(df.drop("__text"), quality.fit(df, labels))
    assert len(scored.columns) == len(set(scored.columns)) and {r.score for r in scored.collect()} == {1.0}
    encoded = pieces.encode_table(df.drop("__text").withColumn("ids", F.lit(1)))
    assert encoded.columns.count("ids") == 1 and encoded.count() == 4
    split = df.drop("__text").withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    judged = urls.score(split, urls.fit(spark.createDataFrame([("u", 1)], "url string, label int")), "url", "host", "path")
    assert len(judged.columns) == len(set(judged.columns)) and judged.count() == 4
