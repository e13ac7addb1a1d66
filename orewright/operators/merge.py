"""Newest row of each key, change detection and upsert."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each key in ``order``; give a total order, or ties fall as they may.

    Ranking is cut off at one before the shuffle, so a hot key sends one row from each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def newest(df: DataFrame, keys: Iterable[str], by: str, *then: Column) -> DataFrame:
    return latest(df, keys, [F.col(by).desc_nulls_first(), *then])


def differs(left: Iterable[Column], right: Iterable[Column]) -> Column:
    """Whether two rows of values differ, nulls being equal."""
    return ~F.struct(*left).eqNullSafe(F.struct(*right))


def merge(old: DataFrame, new: DataFrame, key: str, values: list[str], stamped: dict[str, Column], action: str | None = None) -> DataFrame:
    """``old`` with ``new`` upserted by ``key``: new keys are added; a matched row changes only if one of ``values`` does; keys
    that ``new`` lacks are kept. ``stamped`` gives the columns that are set when a row is added (all of them) or changed
    (those whose name ends in ``_at``). ``new`` has each key once. action: a column that says what happened.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    added, kept = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNull()
    changed = ~added & ~kept & differs([F.col(f"a.{v}") for v in values], [F.col(f"b.{v}") for v in values])
    take = added | changed
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(take, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values]]
    columns += [F.when(take if n.endswith("_at") else added, c).otherwise(F.col(f"a.{n}")).alias(n) for n, c in stamped.items()]
    if action:
        columns.append(F.when(added, "insert").when(changed, "update").when(kept, "kept").otherwise("unchanged").alias(action))
    return joined.select(*columns)
