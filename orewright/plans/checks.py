"""Completeness: rows in each raw file against rows in its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store
from ..sources.catalog import SOURCES
from ..sources.readers import read
from ..sources.spec import Source
from .bronze import chosen

SCHEMA = "source string, table string, status string, in_table long, in_file long, difference long, ok boolean"


def check(store: Store, data: str, source: Source) -> tuple:
    """One row of the report; a missing file or table is a failure, not an error."""
    path, name = f"{data.rstrip('/')}/{source.path}", f"{source.table.layer}.{source.table.name}"
    if not store.files.exists(path):
        return (source.name, name, "file missing", None, None, None, False)
    if not store.exists(source.table):
        return (source.name, name, "table missing", None, None, None, False)
    there = store.read(source.table, source.path).count()
    wanted = read(store.spark, source.format, path).count()
    return (source.name, name, "complete" if there == wanted else "differs", there, wanted, there - wanted, there == wanted)


def completeness(store: Store, data: str, selected: list[str] | None = None, sources: dict[str, Source] = SOURCES) -> DataFrame:
    rows = [check(store, data, sources[n]) for n in chosen(selected, sources)]
    return store.spark.createDataFrame(rows, SCHEMA)


def tally(report: DataFrame) -> tuple[int, bool]:
    """(number of failures, whether all are complete)."""
    failed, ok = report.agg(F.count_if(~F.col("ok")), F.coalesce(F.bool_and("ok"), F.lit(True))).first()
    return failed, ok


def compared(file_counts: DataFrame, table_counts: DataFrame, key: str = "source") -> DataFrame:
    """(key, in_file, in_table, difference, ok) of two count tables with columns (key, n)."""
    a, b = file_counts.select(key, F.col("n").alias("in_file")), table_counts.select(F.col(key).alias("__k"), F.col("n").alias("in_table"))
    both = a.join(b, F.col(key) == F.col("__k"), "left").withColumn("in_table", F.coalesce("in_table", F.lit(0)))
    return both.select(key, "in_file", "in_table", (F.col("in_table") - F.col("in_file")).alias("difference"), (F.col("in_table") == F.col("in_file")).alias("ok"))
