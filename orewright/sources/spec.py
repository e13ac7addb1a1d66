"""Descriptions of tables and sources."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..operators.constraints import Check, Unique

TYPES = {"text": "string", "json": "string"}
LINEAGE = {"_source_file": "string", "_loaded_at": "timestamp"}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool = False
    identity: bool = False

    @property
    def spark_type(self) -> str:
        return TYPES.get(self.kind, self.kind)


@dataclass(frozen=True)
class Table:
    layer: str
    name: str
    columns: tuple[Column, ...]
    unique: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    sort: tuple[str, ...] = ()

    @property
    def identity(self) -> str | None:
        return next((c.name for c in self.columns if c.identity), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns] + list(LINEAGE)

    @property
    def ddl(self) -> str:
        return ", ".join([f"`{c.name}` {c.spark_type}" for c in self.columns] + [f"`{n}` {t}" for n, t in LINEAGE.items()])

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required or c.identity] + list(LINEAGE)


@dataclass(frozen=True)
class Source:
    """A file, the reader that takes it in, and the table that it lands in."""

    name: str
    table: Table
    path: str  # under the data folder; also the value of _source_file
    format: str
    drop: tuple[str, ...] = field(default=())


def table(layer: str, name: str, columns: str, unique: list[Unique] = [], checks: list[Check] = [], sort: list[str] = []) -> Table:
    """A table from text: ``name type [not null] [identity], ...``."""
    made = []
    for part in re.split(r",(?![^(]*\))", columns):
        words = part.split()
        made.append(Column(words[0], words[1], "not" in words[2:], "identity" in words[2:]))
    keys = [k for u in unique for k in u.columns if k != next((c.name for c in made if c.identity), None)]
    return Table(layer, name, tuple(made), tuple(unique), tuple(checks), tuple(sort or dict.fromkeys(keys)))
