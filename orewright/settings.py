"""Settings: a ``.env`` file, overridden by the environment; the session; an optional JDBC connection."""

from __future__ import annotations

import contextlib
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession


_LINE = re.compile(
    r"""\s*(?:export\s+)?(?P<key>[A-Za-z_][A-Za-z0-9_]*)\s*=\s*
    (?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\n#]*?))
    \s*(?:\#.*)?""",
    re.X,
)


def parsed_env(text: str) -> dict[str, str]:
    """The settings in a text of KEY=VALUE lines. A value may stand in a pair of quotes; ``#`` begins a comment outside them;
    lines that aren't settings are passed over; of repeated keys the first counts."""
    found: dict[str, str] = {}
    for m in filter(None, map(_LINE.fullmatch, text.splitlines())):
        found.setdefault(m["key"], next(v for v in (m["double"], m["single"], m["bare"]) if v is not None))
    return found


def load_env(path: str | Path = ".env") -> None:
    """Adds the settings of a file to the environment, whose own variables win. No file, no settings."""
    with contextlib.suppress(FileNotFoundError, IsADirectoryError):
        os.environ |= {k: v for k, v in parsed_env(Path(path).read_text(encoding="utf-8")).items() if k not in os.environ}


def require(key: str) -> str:
    if os.environ.get(key, "") == "":
        raise RuntimeError(f"{key} is not set; put it into the environment or a .env file")
    return os.environ[key]


@dataclass(frozen=True)
class Connection:
    """A database server, from <KIND>_HOST, _PORT, _DB, _USER and _PASSWORD; only the password has no default."""

    kind: str
    host: str
    port: str
    database: str
    user: str
    password: str = field(repr=False)

    @classmethod
    def of(cls, kind: str, port: str = "5432") -> Connection:
        defaults = {"HOST": "localhost", "PORT": port, "DB": kind, "USER": kind}
        values = {k: os.environ.get(f"{kind.upper()}_{k}", v) for k, v in defaults.items()}
        return cls(kind, values["HOST"], values["PORT"], values["DB"], values["USER"], require(f"{kind.upper()}_PASSWORD"))

    @property
    def place(self) -> str:
        return f"{self.host}:{self.port}/{self.database}"

    @property
    def url(self) -> str:
        return f"{self.kind}ql://{quote_plus(self.user)}:{quote_plus(self.password)}@{self.place}"

    def jdbc(self, table: str) -> dict[str, str]:
        return {"url": f"jdbc:{self.kind}ql://{self.place}", "dbtable": table, "user": self.user, "password": self.password, "driver": "org.postgresql.Driver"}


def credentials(kind: str) -> tuple[str, str]:
    """(user, password) of a service."""
    c = Connection.of(kind)
    return c.user, c.password


def postgres_dsn() -> str:
    return Connection.of("postgres").url


def jdbc_options(table: str) -> dict[str, str]:
    return Connection.of("postgres").jdbc(table)


def read_jdbc(spark: SparkSession, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, tasks: int = 8) -> DataFrame:
    """A database table; with a numeric key and its bounds in ``tasks`` ranges at once. Needs the driver's jar."""
    options = jdbc_options(table)
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(tasks)}
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, table: str) -> None:
    df.write.format("jdbc").options(**jdbc_options(table)).option("batchsize", 10_000).mode("append").save()


def session(name: str = "orewright") -> SparkSession:
    """A session with what the engine relies on; a cluster's own settings stay."""
    built = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return built.getOrCreate()
