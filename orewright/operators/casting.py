"""Strict text-to-type casts: a value that doesn't fit raises an error that names its column, whatever the ANSI setting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as true and false, in lower case.
TRUE, FALSE = ("t", "true", "y", "yes", "on", "1", "tr", "tru", "ye"), ("f", "false", "n", "no", "off", "0", "fa", "fal", "fals", "of")
_DATE = r"\A\s*\d{4}-\d{1,2}-\d{1,2}\s*\z"
_TIME = r"\A\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|[+-]\d{1,2}(:?\d{2})?)?)?\s*\z"


def blank_to_null(value: Column) -> Column:
    """The empty string becomes null; white space stays."""
    return F.nullif(value, F.lit(""))


def minified_json(value: Column) -> Column:
    """JSON text without white space between tokens; text that isn't JSON is an error."""
    return F.to_json(F.parse_json(value))


def is_json(value: Column) -> Column:
    """Whether text is JSON; null stays null."""
    return F.when(value.isNotNull(), F.try_parse_json(value).isNotNull())


def strict(value: Column, kind: str, name: str) -> Column:
    """``value`` (text) as ``kind``: text, json, boolean, date, timestamp, a whole number or decimal(p,s)."""
    if kind == "text":
        return value
    if kind == "json":
        return minified_json(value)
    if kind == "boolean":
        low = F.lower(F.trim(value))
        made = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    elif kind == "date":
        made = F.when(value.rlike(_DATE), value.try_cast("date"))
    elif kind == "timestamp":
        made = F.when(value.rlike(_TIME), value.try_cast("timestamp"))
    elif m := re.fullmatch(r"char\((\d+)\)", kind):
        made = F.when(F.length(F.rtrim(value)) <= int(m[1]), value)
    else:
        made = value.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: not a {kind}: "), value)).cast("boolean" if kind == "boolean" else "string" if kind.startswith("char") else kind)
    return F.when(value.isNull(), F.lit(None)).when(made.isNull(), wrong).otherwise(made)
