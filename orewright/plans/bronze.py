"""Raw files into bronze tables: read as text, rename, drop, cast, check, replace the file's rows."""

from __future__ import annotations

import datetime
from collections.abc import Container, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.project import conform, drop, rename
from ..operators.store import Store
from ..sources.catalog import SOURCES
from ..sources.readers import read
from ..sources.spec import Source


@dataclass(frozen=True)
class Loaded:
    """What a load has put into a table."""

    table: str
    rows: int
    source: str


class UnknownSources(ValueError):
    def __init__(self, names: list[str], known: Iterable[str]):
        super().__init__(f"no such source: {', '.join(names)} (there are {', '.join(known)})")
        self.names = names


def strangers(asked: Iterable[str], known: Container[str]) -> list[str]:
    """Those of ``asked`` that aren't ``known``, in their order."""
    return [name for name in asked if name not in known]


def chosen(selected: Sequence[str] | None, sources: Mapping[str, Source] = SOURCES) -> list[str]:
    """The names to load: all sources where nothing is selected, else the selection as it stands if every name is known."""
    if not selected:
        return [*sources]
    if odd := strangers(selected, sources):
        raise UnknownSources(odd, sources)
    return [*selected]


def prepared(spark: SparkSession, source: Source, data: str, loaded_at: datetime.datetime) -> DataFrame:
    """The rows that the source's table would get."""
    raw = drop(rename(read(spark, source.format, f"{data.rstrip('/')}/{source.path}")), source.drop)
    return conform(raw, source.table, source.path, loaded_at)


def load(store: Store, source: Source, data: str, loaded_at: datetime.datetime | None = None) -> Loaded:
    """One source file into its table."""
    at = loaded_at or datetime.datetime.now(datetime.timezone.utc)
    store.create(source.table)
    n = store.replace(source.table, source.path, prepared(store.spark, source, data, at))
    return Loaded(f"{source.table.layer}.{source.table.name}", n, source.path)


def run(store: Store, data: str, selected: list[str] | None = None, sources: dict[str, Source] = SOURCES, loaded_at: datetime.datetime | None = None) -> list[Loaded]:
    """The selected sources one after the other; what was loaded before a failure stays."""
    return [load(store, sources[name], data, loaded_at) for name in chosen(selected, sources)]


def report(spark: SparkSession, loaded: list[Loaded]) -> DataFrame:
    return spark.createDataFrame([(x.table, x.rows, x.source) for x in loaded], "table string, rows long, source string")
