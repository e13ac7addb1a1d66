"""The batch operators on streams: each micro-batch replaces source files or upserts an entity. Beyond what batch loads need."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge, newest
from ..operators.store import Store
from ..sources.spec import Table


def replace_files(stream: DataFrame, store: Store, table: Table, checkpoint: str) -> StreamingQuery:
    """Rows of ``table`` (with lineage) that come as a stream: the rows of each source file in a batch replace that file's.

    A batch that is delivered twice leaves the same table.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for r in batch.select("_source_file").distinct().collect():  # as many as there are files
                rows = batch.where(F.col("_source_file") == r[0])
                store.replace(table, r[0], rows.drop(table.identity) if table.identity else rows)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_newest(stream: DataFrame, store: Store, table: Table, key: str, by: str, values: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key: batches are reduced to one row a key and merged; changed rows get a new ``loaded_at``."""

    def put(batch: DataFrame, _: int) -> None:
        at = datetime.datetime.now(datetime.timezone.utc)
        store.create(table)
        old = store.read(table).select(*[c.name for c in table.columns])
        one = newest(batch, [key], by, *[F.col(v) for v in values]).select(key, *values)
        made = merge(old, one, key, values, {"loaded_at": F.lit(at).cast("timestamp")})
        rows = made.select(*[c.name for c in table.columns], F.lit(table.name).alias("_source_file"), F.lit(at).cast("timestamp").alias("_loaded_at"))
        store.replace(table, table.name, rows)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by hour and type, with a watermark so that state is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
