"""Readers: every value as text, nothing converted. A format is a name in ``READERS``; ``register`` adds one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        READERS[name] = reader
        return reader

    return add


def read(spark: SparkSession, format: str, path: str) -> DataFrame:
    if format not in READERS:
        raise ValueError(f"unknown format {format}; known: {', '.join(sorted(READERS))}")
    return READERS[format](spark, path)


_CSV = {"quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8", "mode": "PERMISSIVE"}
_BAD = "�"


def csv_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """The names in the first record, as they stand there."""
    first = spark.read.options(**_CSV | {"multiLine": multi_line}, header=False).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path}: no header")
    names = [v or "" for v in first[0]]
    return [names[0].removeprefix("\ufeff"), *names[1:]]


def _fields(record: Column) -> Column:
    """How many fields a raw record has: its commas outside quoted fields, and one."""
    bare = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), '(^|,)"[^"]*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


@register("csv_lines")
def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``csv`` for files whose quoted fields hold no line ends: such files are split among tasks."""
    return read_csv(spark, path, multi_line=False)


@register("csv")
def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """UTF-8 CSV with a header. Empty fields are null, all other text stays (``NA`` too); short rows are filled with null;
    lines of white space aren't rows; a row with more fields than the header (empty ones too), and bytes that aren't UTF-8,
    are errors.

    Names are those of the header. A file that may hold quoted line ends can't be split, so it is one task; ``csv_lines``
    is for large files without them.
    """
    names = csv_header(spark, path, multi_line)
    inner = [f"c{k}" for k in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*inner, "_odd"])  # the raw text of records that are shorter or longer than the header
    raw = spark.read.schema(schema).options(**_CSV | {"multiLine": multi_line, "columnNameOfCorruptRecord": "_odd"}, header=True, enforceSchema=True).csv(path)
    blank = F.coalesce(F.trim(F.regexp_replace("c0", r"[\s﻿]+", " ")), F.lit("")) == ""
    for c in inner[1:]:
        blank = blank & F.col(c).isNull()
    odd = F.concat_ws("", *inner).contains(_BAD)
    fits = (
        F.when(F.col("_odd").isNotNull() & (_fields(F.col("_odd")) > len(inner)), F.raise_error(F.lit(f"{path}: a row has more fields than the header")).cast("boolean"))
        .when(odd, F.raise_error(F.lit(f"{path}: bytes that are not UTF-8")).cast("boolean"))
        .otherwise(True)
    )
    only_one = F.lit(True) if len(inner) > 1 else F.col("c0").isNotNull()
    return raw.where(~blank & only_one).where(fits).drop("_odd").toDF(*names)


_FEATURE = "properties map<string,string>, geometry string"


def bare_json(text: Column) -> Column:
    """JSON text without white space outside strings; the order of keys and the spelling of numbers stay."""
    return F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+', "$1")


def _flat(each: DataFrame) -> DataFrame:
    """Features (at, p, g) as one column for each property name, in the order of first sight, and the geometry."""
    seen = each.select("at", F.posexplode(F.map_keys("p")).alias("k", "name")).groupBy("name").agg(F.min(F.struct("at", "k")).alias("first"))
    names = [r.name for r in seen.orderBy("first", "name").collect()]  # as many as there are names
    own = [n for n in names if n not in ("geometry_type", "geometry")]

    def value(n: str) -> Column:
        v = F.col("p")[n]
        nested = v.rlike(r"\A\s*[\[{]") & F.try_parse_json(v).isNotNull()
        return F.nullif(F.when(nested, bare_json(v)).otherwise(v), F.lit("")).alias(n)

    shape = bare_json(F.col("g"))
    shape = F.when(~shape.isin("{}", "null"), shape)
    return each.select(*map(value, own), F.get_json_object("g", "$.type").alias("geometry_type"), shape.alias("geometry"))


def _properties(column: str) -> Column:
    return F.coalesce(column, F.create_map().cast("map<string,string>"))


@register("geojson")
def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of a collection: its properties as text, and its geometry.

    Columns are the union of all property names in the order of first sight, then ``geometry_type`` and ``geometry`` (JSON
    without white space between tokens, else as it stands; null where there is none). Numbers keep their spelling, lists and
    objects are such JSON. A document without ``features`` has no rows; null features and text that isn't JSON are errors.
    A document is one task; ``geojson_lines`` is for large data.
    """
    whole = spark.read.schema(f"features array<struct<{_FEATURE.replace(' map', ':map').replace(' string', ':string')}>>").options(multiLine=True, mode="FAILFAST").json(path)
    if whole.where("features is null").limit(1).count():
        told = spark.read.text(path, wholetext=True).where(F.array_contains(F.json_object_keys("value"), "features"))
        if told.limit(1).count():
            raise ValueError(f"{path}: features is null")
    return _flat(whole.select(F.posexplode("features").alias("at", "f")).select("at", _properties("f.properties").alias("p"), F.col("f.geometry").alias("g")))


@register("geojson_lines")
def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``geojson`` for files with one feature a line, which are split among tasks; blank lines aren't rows."""
    lines = spark.read.schema(f"type string, {_FEATURE}").options(mode="FAILFAST").json(path)
    return _flat(lines.select(F.monotonically_increasing_id().alias("at"), _properties("properties").alias("p"), F.col("geometry").alias("g")))
