"""NOT NULL, CHECK and uniqueness: counted with aggregates, so no check can be pruned away, and told with a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Rows break a rule; the message names each rule, how many rows break it, and one of them."""


@dataclass(frozen=True)
class Check:
    """A predicate that must not be false; null passes."""

    name: str
    holds: Callable[[], Column]


@dataclass(frozen=True, init=False)
class Unique:
    """Columns whose values may occur once; rows with a null in them are all distinct."""

    columns: tuple[str, ...]

    def __init__(self, *columns: str):
        object.__setattr__(self, "columns", columns)


def in_range(column: str, low: int, high: int) -> Callable[[], Column]:
    return lambda: F.col(column).between(low, high)


def in_set(column: str, *values: int | str) -> Callable[[], Column]:
    return lambda: F.col(column).isin(*values)


def matches(column: str, pattern: str) -> Callable[[], Column]:
    """The whole value matches ``pattern``; a trailing line end doesn't pass."""
    return lambda: F.col(column).rlike(rf"\A(?:{pattern})\z")


def violations(df: DataFrame, required: Iterable[str] = (), checks: Iterable[Check] = ()) -> DataFrame:
    """One row (rule, n) for each NOT NULL and CHECK rule, from one pass."""
    counted = [F.count_if(F.col(c).isNull()).alias(f"not null {c}") for c in required]
    counted += [F.count_if(F.coalesce(~c.holds(), F.lit(False))).alias(f"check {c.name}") for c in checks]
    if not counted:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    one = df.agg(*counted)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in one.columns])).alias("x")).select("x.rule", "x.n")


def duplicates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their count; keys with a null are left out."""
    columns = list(columns)
    full = df
    for c in columns:
        full = full.where(F.col(c).isNotNull())
    return full.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated(df: DataFrame, unique: Unique) -> str | None:
    """What to say of keys that occur more than once, from one pass; None if there are none."""
    found = duplicates(df, unique.columns)
    n, worst = found.agg(F.count(F.lit(1)), F.max(F.struct("n", *unique.columns))).first()
    return f"unique ({', '.join(unique.columns)}): {n} keys, such as {tuple(worst[1:])} with {worst[0]} rows" if n else None


def clashes(new: DataFrame, others: DataFrame, unique: Unique) -> str | None:
    """What to say of keys of ``new`` that ``others`` hold already. Only the key columns of ``others`` are read, and only row
    groups whose range of the first key column meets that of ``new``."""
    first = unique.columns[0]
    low, high = new.agg(F.min(first), F.max(first)).first()
    if low is None:
        return None
    there = others.where(F.col(first).between(F.lit(low), F.lit(high))).select(*unique.columns)
    found = there.join(new.select(*unique.columns).distinct(), list(unique.columns), "left_semi")
    n, one = found.agg(F.count(F.lit(1)), F.max(F.struct(*unique.columns))).first()
    return f"unique ({', '.join(unique.columns)}): {n} rows of other files have the same keys, such as {tuple(one)}" if n else None


def validate(new: DataFrame, others: DataFrame | None = None, required: Iterable[str] = (), checks: Iterable[Check] = (), unique: Iterable[Unique] = ()) -> None:
    """Raises ConstraintError unless ``new`` satisfies the row rules, and its keys are unique among themselves and ``others``,
    which are known to satisfy them."""
    broken = [f"{r.rule}: {r.n} rows" for r in violations(new, required, checks).where("n > 0").collect()]
    for u in unique:
        broken += [x for x in (repeated(new, u), clashes(new, others, u) if others is not None else None) if x]
    if broken:
        raise ConstraintError("; ".join(broken))


def orphans(child: DataFrame, parent: DataFrame, on: str, to: str) -> DataFrame:
    """Rows of ``child`` whose ``on`` isn't null and names no ``to`` of ``parent``: a report, never enforced."""
    keys = parent.select(F.col(to).alias("__to")).distinct()
    return child.where(F.col(on).isNotNull()).join(keys, F.col(on) == F.col("__to"), "left_anti")
