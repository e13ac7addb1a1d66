from __future__ import annotations

from pyspark.sql import functions as F

from orewright.operators.store import Store
from orewright.sources.catalog import RENTS
from orewright.sources.spec import table
from orewright.streaming import incremental


def test_files_replaced_from_a_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"))
    rows = spark.createDataFrame([(1, "f1"), (2, "f1"), (3, "f2")], "rent_id int, _source_file string")
    wide = rows.select(*[F.col(n) if n in rows.columns else F.current_timestamp().alias(n) if n == "_loaded_at" else F.lit(None).cast(dict(c.split(" ", 1) for c in RENTS.ddl.replace("`", "").split(", "))[n]).alias(n) for n in RENTS.names])
    wide.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(wide.schema).parquet(str(tmp_path / "in"))
        incremental.replace_files(stream, store, RENTS, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.rent_id for r in store.read(RENTS).collect()) == [1, 2, 3]
    assert set(store.manifest(RENTS).parts) == {"f1", "f2"}


def test_newest_upserted_from_a_stream(spark, tmp_path):
    goal, store = table("silver", "t", "k int, v text, loaded_at timestamp"), Store(spark, str(tmp_path / "w"))
    for part, rows in enumerate(([(1, "a", 1), (1, "b", 2), (2, "x", 1)], [(2, "x", 5), (3, "z", 1)])):
        spark.createDataFrame(rows, "k int, v string, n int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, v string, n int").parquet(str(tmp_path / "in"))
        incremental.upsert_newest(stream, store, goal, "k", "n", ["v"], str(tmp_path / "cp")).awaitTermination()
        seen = {r.k: (r.v, r.loaded_at) for r in store.read(goal).collect()}
        if part == 0:
            first = seen
    assert {k: v for k, (v, _) in seen.items()} == {1: "b", 2: "x", 3: "z"}
    assert seen[2][1] == first[2][1]


def test_windowed_counts_with_watermark(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = incremental.hourly_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hourly").collect()) == [1, 2]
