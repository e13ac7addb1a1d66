"""Silver entities: cleaned, one row a key, upserted with change detection."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, not_blank, trimmed_or_null, upper_or_null
from ..operators.casting import strict
from ..operators.constraints import Check, Unique, matches
from ..operators.merge import merge, newest
from ..operators.store import Store
from ..sources.catalog import SCHOOLS
from ..sources.spec import Column, Table

RECORD_SOURCE = "NSW_DOE_SCHOOL_LOCATIONS"
VALUES = ["school_name", "street", "town_suburb", "postcode"]
SCHOOL = Table(
    "silver", "school",
    (Column("school_code", "int", True), Column("school_name", "text", True), Column("street", "text"), Column("town_suburb", "text"), Column("postcode", "text"), Column("record_source", "text", True), Column("loaded_at", "timestamp", True)),
    (Unique("school_code"),),
    (Check("postcode", matches("postcode", "[0-9]{4}")),),
    ("school_code",),
)


def cleaned(bronze: DataFrame) -> DataFrame:
    """School rows with a key and a name, cleaned, the newest of each key."""
    wanted = bronze.select("school_code", *VALUES, "_loaded_at").where(F.col("school_code").isNotNull() & not_blank(F.col("school_name")))
    one = newest(wanted, ["school_code"], "_loaded_at", *map(F.col, VALUES))  # one load has one time: then by value, so that it is always the same row
    return one.select(
        "school_code", F.trim("school_name").alias("school_name"), collapsed(F.col("street")).alias("street"), upper_or_null(F.col("town_suburb")).alias("town_suburb"),
        strict(trimmed_or_null(F.col("postcode")), "char(4)", "postcode").alias("postcode"),
    )


def upserted(old: DataFrame, bronze: DataFrame, at: datetime.datetime, action: str | None = None) -> DataFrame:
    return merge(old, cleaned(bronze), "school_code", VALUES, {"record_source": F.lit(RECORD_SOURCE), "loaded_at": F.lit(at).cast("timestamp")}, action)


def build_schools(store: Store, loaded_at: datetime.datetime | None = None) -> int:
    """Upserts the schools into silver; the number of silver rows. A row that breaks a rule stops the whole run."""
    at = loaded_at or datetime.datetime.now(datetime.timezone.utc)
    store.create(SCHOOL)
    old = entity(store)
    made = upserted(old, store.read(SCHOOLS), at)
    rows = made.select(*[c.name for c in SCHOOL.columns], F.lit("school").alias("_source_file"), F.lit(at).cast("timestamp").alias("_loaded_at"))
    return store.replace(SCHOOL, "school", rows)


def entity(store: Store) -> DataFrame:
    """The silver schools."""
    return store.read(SCHOOL).select(*[c.name for c in SCHOOL.columns])
