from __future__ import annotations

import datetime
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orewright.functions.naming import snake_case, snake_cased
from orewright.functions.text import collapsed, not_blank, upper_or_null
from orewright.operators.casting import blank_to_null, strict


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("PlanningPortalApplicationNumber", "planning_portal_application_number"),
        ("AccompaniedByVPAFlag", "accompanied_by_vpa_flag"),
        ("already_lower", "already_lower"),
        ("LBOTE_pct", "lbote_pct"),
        ("StreetNumber1", "street_number1"),
        ("Two Words", "two words"),
        ("HTTPServer2XX", "http_server2_xx"),
        ("  RentId ", "rent_id"),
        ("a-B", "a-b"),
        ("", ""),
        ("ÄrgerX", "ärger_x"),
    ],
)
def test_snake_case(name, want):
    assert snake_case(name) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBzZ09_é -", max_size=14))
def test_snake_case_follows_its_two_rules(name):
    s = re.sub("(?<=[A-Z])(?=[A-Z][a-z])", "_", name.strip())
    assert snake_case(name) == re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", s).lower()


def test_names_that_collide():
    with pytest.raises(ValueError, match="lga_name"):
        snake_cased(["LgaName", "lga_name"])


def one(spark, value, kind):
    return spark.createDataFrame([(value,)], "v string").select(strict(F.col("v"), kind, "v").alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        (None, "int", None), ("12", "int", 12), (" 7 ", "int", 7), ("-32768", "smallint", -32768), ("9000000000", "bigint", 9000000000),
        ("1.005", "decimal(10,2)", Decimal("1.01")), ("-1.005", "decimal(10,2)", Decimal("-1.01")),
        ("Y", "boolean", True), ("N", "boolean", False), ("true", "boolean", True), ("f", "boolean", False), ("1", "boolean", True), ("0", "boolean", False), ("on", "boolean", True), ("off", "boolean", False),
        ("2024-02-29", "date", datetime.date(2024, 2, 29)), ("2000", "char(4)", "2000"), (" x ", "text", " x "),
        ('{"a" : [1, 2]}', "json", '{"a":[1,2]}'),
    ],
)
def test_casts(spark, value, kind, want):
    assert one(spark, value, kind) == want


@pytest.mark.parametrize(("value", "kind"), [("1.0", "int"), ("99999", "smallint"), ("2024", "date"), ("2024-02-30", "date"), ("123456789012", "decimal(10,2)"), ("maybe", "boolean"), ("20000", "char(4)"), ("{", "json"), ("x", "timestamp"), ("12", "timestamp")])
def test_bad_casts_name_the_column(spark, value, kind):
    with pytest.raises(Exception, match="column v|MALFORMED"):
        one(spark, value, kind)


def test_offsets_and_session_zone(spark):
    made = spark.createDataFrame([("2024-01-01 10:00:00+11",), ("2024-01-01 10:00:00",)], "v string").select(strict(F.col("v"), "timestamp", "v").cast("string").alias("r"))
    assert [r.r for r in made.collect()] == ["2023-12-31 23:00:00", "2024-01-01 10:00:00"]


def test_cleaning_order(spark):
    df = spark.createDataFrame([("  A  ",), ("1   X\tSt",), ("\t",), ("   ",), (None,), ("",)], "v string")
    got = df.select(collapsed(F.col("v")).alias("c"), upper_or_null(F.col("v")).alias("u"), not_blank(F.col("v")).alias("n"), blank_to_null(F.col("v")).alias("b")).collect()
    assert [r.c for r in got] == ["A", "1 X St", " ", None, None, None]
    assert [r.u for r in got] == ["A", "1   X\tST", "\t", None, None, None]
    assert [r.n for r in got] == [True, True, True, False, False, False]
    assert [r.b for r in got] == ["  A  ", "1   X\tSt", "\t", "   ", None, None]
