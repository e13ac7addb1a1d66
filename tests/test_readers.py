from __future__ import annotations

import json

import pytest

from orewright.sources import readers


def csv(spark, tmp_path, raw: bytes, format="csv"):
    path = tmp_path / "x.csv"
    path.write_bytes(raw)
    df = readers.read(spark, format, str(path))
    return df.columns, [tuple(r) for r in df.collect()]


def test_bom_header_and_literals(spark, tmp_path):
    assert csv(spark, tmp_path, b"\xef\xbb\xbfRentId,LgaName\nNA,null\nnan, \n") == (["RentId", "LgaName"], [("NA", "null"), ("nan", " ")])


def test_quotes_line_ends_and_backslash(spark, tmp_path):
    raw = b'a,b\n"x\ny","say ""hi"""\nc\\d,"\\"\n'
    assert csv(spark, tmp_path, raw)[1] == [("x\ny", 'say "hi"'), ("c\\d", "\\")]


def test_empty_short_and_blank(spark, tmp_path):
    assert csv(spark, tmp_path, b'a,b,c\n1,,""\n2\n\n   \n3,4,5\n')[1] == [("1", None, None), ("2", None, None), ("3", "4", "5")]


@pytest.mark.parametrize("raw", [b"a,b\n1,2,3\n", b"a,b\n1,\xe9\n", b"a,b\n1,2,\n", b'a,b\n"1,""x",2,\n', b"a\n1,\n"])
def test_long_rows_and_latin1_fail(spark, tmp_path, raw):
    with pytest.raises(Exception, match="more fields|not UTF-8"):
        csv(spark, tmp_path, raw)


def test_count_also_checks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        readers.read(spark, "csv", str(tmp_path / "x.csv")).count()


def test_same_names_in_other_case_and_lines(spark, tmp_path):
    assert csv(spark, tmp_path, b"l_A,L_A\n1,2\n")[0] == ["l_A", "L_A"]
    assert csv(spark, tmp_path, b"a,b\n1,2\n3,4\n", "csv_lines")[1] == [("1", "2"), ("3", "4")]
    assert csv(spark, tmp_path, b"a,b\n")[1] == []


def test_unknown_format_and_registry(spark):
    with pytest.raises(ValueError, match="unknown format nope"):
        readers.read(spark, "nope", "x")
    readers.register("made")(lambda s, p: s.range(3).toDF("n"))
    assert readers.read(spark, "made", "").count() == 3
    del readers.READERS["made"]


def geo(spark, tmp_path, doc):
    path = tmp_path / "x.geojson"
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    df = readers.read(spark, "geojson", str(path))
    return [r.asDict() for r in df.collect()]


def test_ragged_features(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"properties":{"id":1,"name":"É","list":["a","b"],"flag":true,"zero":0.0},"geometry":{"type":"Point","coordinates":[151.0800, -33.79]}},{"properties":{"id":2,"extra":null},"geometry":null},{"properties":null,"geometry":{}}]}'
    a, b, c = geo(spark, tmp_path, doc)
    assert (a["id"], a["name"], json.loads(a["list"]), a["flag"], a["zero"], a["geometry_type"]) == ("1", "É", ["a", "b"], "true", "0.0", "Point")
    assert json.loads(a["geometry"]) == {"type": "Point", "coordinates": [151.08, -33.79]}
    assert (b["id"], b["extra"], b["geometry"], b["geometry_type"]) == ("2", None, None, None)
    assert set(c.values()) == {None}


@pytest.mark.parametrize("doc", ['{"features": []}', "{}"])
def test_no_features(spark, tmp_path, doc):
    assert geo(spark, tmp_path, doc) == []


@pytest.mark.parametrize("doc", ['{"features": [{"prop', '{"features": null}'])
def test_broken_documents_fail(spark, tmp_path, doc):
    with pytest.raises(Exception):  # noqa: B017, PT011
        geo(spark, tmp_path, doc)


def test_commas_in_quotes_are_no_fields(spark, tmp_path):
    assert csv(spark, tmp_path, b'a,b,c\n"1,2,3,4"\n"x ""y"", z","q,r"\n')[1] == [("1,2,3,4", None, None), ('x "y", z', "q,r", None)]


def test_names_in_order_of_sight_and_geometry_as_it_stands(spark, tmp_path):
    doc = '{"features": [{"properties": {"z": 1, "a": [1,  {"k": "x  y"}]}, "geometry": {"type": "Point",\n "coordinates": [-33.0, 1e2]}}, {"properties": {"m": 0.10, "a": null}, "geometry": null}]}'
    path = tmp_path / "x.geojson"
    path.write_text(doc)
    df = readers.read(spark, "geojson", str(path))
    assert df.columns == ["z", "a", "m", "geometry_type", "geometry"]
    first, second = df.collect()
    assert first.a == '[1,{"k":"x  y"}]' and first.geometry == '{"type":"Point","coordinates":[-33.0,1e2]}' and second.m == "0.10"
    (tmp_path / "y.geojsonl").write_text('{"properties": {"b": 1}}\n\n{"properties": {"a": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}\n')
    df = readers.read(spark, "geojson_lines", str(tmp_path / "y.geojsonl"))
    assert df.columns == ["b", "a", "geometry_type", "geometry"] and sorted(tuple(r) for r in df.na.fill("").collect()) == [("", "x", "Point", '{"type":"Point","coordinates":[1,2]}'), ("1", "", "", "")]
