"""Cleaning of text columns; spaces are trimmed as such, tabs and line ends aren't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def collapsed(value: Column) -> Column:
    """Trimmed first, runs of ASCII white space to one space next, empty to null last: a lone tab becomes a space."""
    return F.nullif(F.regexp_replace(F.trim(value), r"\s+", " "), F.lit(""))


def upper_or_null(value: Column) -> Column:
    return F.upper(trimmed_or_null(value))


def not_blank(value: Column) -> Column:
    return trimmed_or_null(value).isNotNull()
