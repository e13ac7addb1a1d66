"""From a text frame to a table's columns: renaming, dropping, casting, lineage and identity."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import snake_cased
from ..sources.spec import LINEAGE, Table
from .casting import blank_to_null, strict


def rename(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_cased(df.columns))


def drop(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Without ``columns``; those that aren't there are no matter."""
    return df.drop(*columns)


def empty_to_null(df: DataFrame) -> DataFrame:
    """The empty string becomes null in every text column."""
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def conform(df: DataFrame, table: Table, source: str, loaded_at: datetime.datetime) -> DataFrame:
    """``df`` (text, by name) as rows of ``table``: cast, in table order, absent columns null, lineage added.

    A column that the table doesn't have is an error, as is one for its identity, which ``numbered`` fills.
    """
    known = {c.name: c for c in table.columns if not c.identity}
    strange = [c for c in df.columns if c not in known]
    if strange:
        raise ValueError(f"{table.layer}.{table.name} has no column {', '.join(strange)}")
    columns = [strict(blank_to_null(F.col(f"`{n}`")), c.kind, n).alias(n) if n in df.columns else F.lit(None).cast(c.spark_type).alias(n) for n, c in known.items()]
    return df.select(*columns, F.lit(source).alias("_source_file"), F.lit(loaded_at).cast(LINEAGE["_loaded_at"]).alias("_loaded_at"))


def numbered(df: DataFrame, table: Table, next_id: int) -> DataFrame:
    """With the table's identity column: unique, above all earlier numbers, with gaps, without a shuffle."""
    if table.identity is None:
        return df
    return df.withColumn(table.identity, F.lit(next_id) + F.monotonically_increasing_id()).select(*table.names)
