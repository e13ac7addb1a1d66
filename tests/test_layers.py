from __future__ import annotations

import datetime
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from orewright.operators.constraints import ConstraintError
from orewright.operators.store import Store
from orewright.plans import bronze, checks, silver, stops
from orewright.sources.catalog import RENTS, ROUTES, SALES, SCHOOLS, SOURCES, STOPS, TABLES
from orewright.sources.spec import Source

UTC = datetime.timezone.utc
T1, T2 = datetime.datetime(2024, 1, 1, tzinfo=UTC), datetime.datetime(2024, 2, 1, tzinfo=UTC)


@pytest.fixture
def place(spark, tmp_path):
    return Store(spark, str(tmp_path / "warehouse")), tmp_path / "data"


def put(data, name, text):
    path = data / SOURCES[name].path
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


RENT = "RentId,LgaName,PeriodStart,MedianWeeklyRent,bedrooms\n"


def rents(store):
    return sorted(tuple(r) for r in store.read(RENTS).select("rent_id", "lga_name").collect())


def test_columns_of_all_tables():
    assert len(TABLES) == 8 and sum(len(t.names) for t in TABLES.values()) == 238
    assert {t.name for t in TABLES.values() if t.identity} == {"property_sales", "bus_routes"}


def test_load_reload_and_zero_rows(place):
    store, data = place
    put(data, "rent_data", RENT + "1,Åre,2024-01-01,450.125,\n2,,2024-01-02,,\n")
    (x,) = bronze.run(store, str(data), ["rent_data"], loaded_at=T1)
    assert (x.table, x.rows, x.source) == ("bronze.rent_data", 2, SOURCES["rent_data"].path)
    row = store.read(RENTS).where("rent_id = 1").first()
    assert (str(row.median_weekly_rent), row.dwelling_type, row._source_file) == ("450.13", None, x.source)
    assert store.read(RENTS).columns == RENTS.names
    for text, want in ((RENT + "1,Åre,2024-01-01,450,\n2,,,,\n", [(1, "Åre"), (2, None)]), (RENT + "3,x,,,\n", [(3, "x")]), (RENT, [])):
        put(data, "rent_data", text)
        bronze.run(store, str(data), ["rent_data"])
        assert rents(store) == want


@pytest.mark.parametrize(
    "text",
    [
        RENT + "1,a,,,\n1,b,,,\n", RENT + "1.0,a,,,\n", RENT + "1,a,2024,,\n", RENT + "1,a,2024-02-30,,\n", RENT + ",a,,,\n", RENT + "1,a,,123456789012,\n", "LgaName\nx\n", "RentId,Strange\n1,2\n",
        "RentId,rent_id\n1,2\n", RENT + "1,a,,,,\"x\"\n",
    ],
)
def test_failed_loads_leave_the_old_rows(place, text):
    store, data = place
    put(data, "rent_data", RENT + "7,old,,,\n")
    bronze.run(store, str(data), ["rent_data"])
    put(data, "rent_data", text)
    with pytest.raises(Exception):  # noqa: B017, PT011
        bronze.run(store, str(data), ["rent_data"])
    assert rents(store) == [(7, "old")] and len(store.manifest(RENTS).parts) == 1


def test_keys_hold_across_files_and_files_are_apart(place):
    store, data = place
    put(data, "rent_data", "rent_id\n1\n2\n")
    bronze.run(store, str(data), ["rent_data"])
    other = Source("more", RENTS, "raw/more.csv", "csv")
    (data / "raw/more.csv").write_text("rent_id\n3\n")
    bronze.run(store, str(data), None, {"more": other})
    (data / "raw/more.csv").write_text("rent_id\n2\n")
    with pytest.raises(ConstraintError, match="rent_id"):
        bronze.run(store, str(data), None, {"more": other})
    assert [r[0] for r in rents(store)] == [1, 2, 3]
    put(data, "rent_data", "rent_id\n9\n")
    bronze.run(store, str(data), ["rent_data"])
    assert [r[0] for r in rents(store)] == [3, 9]
    assert store.read(RENTS, other.path).count() == 1
    store.remove(RENTS, other.path)
    assert [r[0] for r in rents(store)] == [9]


def test_checks_and_null_passes(place):
    store, data = place
    head = "SegmentId,ObservationDate,HourOfDay\n"
    put(data, "traffic_volume", head + "S1,2024-01-01,24\n")
    with pytest.raises(ConstraintError, match="hour_of_day"):
        bronze.run(store, str(data), ["traffic_volume"])
    put(data, "traffic_volume", head + "S1,2024-01-01,23\nS1,2024-01-01,0\n")
    assert bronze.run(store, str(data), ["traffic_volume"])[0].rows == 2
    edge = lambda k: {"properties": {"edge_id": 1, "direction_id": k}, "geometry": None}
    put(data, "bus_graph_edges", json.dumps({"features": [edge(None)]}))
    assert bronze.run(store, str(data), ["bus_graph_edges"])[0].rows == 1
    put(data, "bus_graph_edges", json.dumps({"features": [edge(2)]}))
    with pytest.raises(ConstraintError, match="direction_id"):
        bronze.run(store, str(data), ["bus_graph_edges"])


def test_identity_never_repeats(place):
    store, data = place
    feature = lambda r: {"properties": {"RouteId": r, "direction_id": 1}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4.50]]}}
    put(data, "bus_routes", json.dumps({"features": [feature("a"), feature("b")]}))
    bronze.run(store, str(data), ["bus_routes"])
    first = {r[0] for r in store.read(ROUTES).select("_row_id").collect()}
    bronze.run(store, str(data), ["bus_routes"])
    rows = store.read(ROUTES).collect()
    assert len(first) == 2 and min(r._row_id for r in rows) > max(first)
    assert json.loads(rows[0].geometry)["coordinates"] == [[1, 2], [3, 4.5]] and rows[0].geometry_type == "LineString"
    put(data, "property_sales", "source_archive,source_file,source_line,load_to\na,f,1,\na,f,2,\n")
    bronze.run(store, str(data), ["property_sales"])
    assert store.read(SALES).select("_row_id").distinct().count() == 2


def test_empty_geojson_is_a_delete(place):
    store, data = place
    put(data, "bus_stops", json.dumps({"features": [{"properties": {"stop_id": 1, "routes_served": ["515", "521"]}, "geometry": {"type": "Point", "coordinates": [151, -33]}}]}))
    bronze.run(store, str(data), ["bus_stops"])
    assert json.loads(store.read(STOPS).first().routes_served) == ["515", "521"]
    put(data, "bus_stops", "{}")
    assert bronze.run(store, str(data), ["bus_stops"])[0].rows == 0
    assert store.read(STOPS).count() == 0


def test_selection():
    assert bronze.chosen([]) == list(SOURCES) and bronze.chosen(["rent_data", "bus_stops"]) == ["rent_data", "bus_stops"]
    with pytest.raises(ValueError, match="nope, no.*rent_data"):
        bronze.chosen(["nope", "rent_data", "no"])


def schools(*rows):
    return "school_code,school_name,street,town_suburb,postcode,support_classes\n" + "".join(",".join(r) + "\n" for r in rows)


def test_silver_cleans_and_upserts(place):
    store, data = place
    load = lambda text, at: (put(data, "school_location", text), bronze.run(store, str(data), ["school_location"], loaded_at=at), silver.build_schools(store, at))[-1]
    n = load(schools(("1", "  A  ", '"1   X\tSt"', " perth ", " "), ("2", "B", "\t", "x", "2000"), ("3", "  ", "s", "t", "2000")), T1)
    got = {r.school_code: r for r in silver.entity(store).collect()}
    assert n == 2 and set(got) == {1, 2}
    assert (got[1].school_name, got[1].street, got[1].town_suburb, got[1].postcode) == ("A", "1 X St", "PERTH", None)
    assert got[2].street == " " and got[2].record_source == silver.RECORD_SOURCE
    assert load(schools(("2", "B", "\t", "x", "2001"), ("4", "D", "", "", "")), T2) == 3
    got = {r.school_code: r for r in silver.entity(store).withColumn("at", F.col("loaded_at").cast("string")).collect()}
    assert {k: r.at[:7] for k, r in got.items()} == {1: "2024-01", 2: "2024-02", 4: "2024-02"}
    assert silver.build_schools(store) == 3
    assert {r[0][:7] for r in silver.entity(store).select(F.col("loaded_at").cast("string")).collect()} == {"2024-01", "2024-02"}


@pytest.mark.parametrize("postcode", ["123", "20000", '"2000\n"'])
def test_one_bad_postcode_stops_silver(place, postcode):
    store, data = place
    put(data, "school_location", schools(("1", "A", "s", "t", "2000")))
    bronze.run(store, str(data), ["school_location"])
    silver.build_schools(store)
    put(data, "school_location", schools(("1", "Z", "s", "t", postcode), ("2", "B", "s", "t", "2000")))
    bronze.run(store, str(data), ["school_location"])
    with pytest.raises(Exception):  # noqa: B017, PT011
        silver.build_schools(store)
    assert [r.school_name for r in silver.entity(store).collect()] == ["A"]


def test_newest_wins(place):
    store, _ = place
    rows = [(1, "old", T1), (1, "new", T2), (2, "x", T1)]
    df = store.spark.createDataFrame(rows, "school_code int, school_name string, _loaded_at timestamp")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("street", "town_suburb", "postcode")})
    assert sorted(r.school_name for r in silver.cleaned(df).collect()) == ["new", "x"]


def test_completeness(place):
    store, data = place
    put(data, "rent_data", "rent_id\n1\n2\n")
    bronze.run(store, str(data), ["rent_data"])
    put(data, "bus_stops", "{}")
    report = checks.completeness(store, str(data), ["rent_data", "bus_stops", "bus_routes"])
    got = {r.source: (r.status, r.difference, r.ok) for r in report.collect()}
    assert got == {"rent_data": ("complete", 0, True), "bus_stops": ("table missing", None, False), "bus_routes": ("file missing", None, False)}
    assert checks.tally(report) == (2, False)
    put(data, "rent_data", "rent_id\n1\n2\n3\n")
    assert checks.completeness(store, str(data), ["rent_data"]).first().difference == -1
    assert checks.tally(report.limit(0)) == (0, True)


def test_commands(place, capsys):
    from orewright import check, run

    store, data = place
    put(data, "rent_data", "rent_id\n1\n")
    args = ["--data", str(data), "--warehouse", store.root, "rent_data"]
    assert run.main(args) == 0 and check.main(args) == 0
    assert "1 rows from raw/rent_data" in capsys.readouterr().out
    assert check.main(args[:-1] + ["bus_stops"]) == 1


def test_stops_near_schools(spark):
    a = spark.createDataFrame([(1, -33.80, 151.00), (2, -33.90, 151.20), (3, 10.0, 10.0), (4, None, None)], "school_code int, latitude double, longitude double")
    b = spark.createDataFrame([(10, -33.801, 151.0), (11, -33.8005, 151.0), (12, -33.91, 151.2)], "stop_id int, lat double, lon double")
    got = {r.school_code: r for r in stops.near(a, b).collect()}
    assert (got[1].nearest_stop_id, got[1].n_within) == (11, 2) and abs(got[1].nearest_m - 55.6) < 1
    assert (got[2].nearest_stop_id, got[2].n_within) == (12, 0)
    assert got[3].nearest_stop_id is None and got[4].n_within == 0


def test_stops_near_many_schools_at_few_points(spark):
    """60,000 schools and 60,000 stops at 40 points each: 3,600,000,000 pairs, all within reach; minutes if each is met."""
    at = lambda k, step: (F.lit(-33.8) + (k % 40) / step).alias("latitude")
    k = F.col("id")
    a = spark.range(60_000).select(k.alias("school_code"), at(k, 8000.0), F.lit(151.0).alias("longitude"))
    b = spark.range(60_000).select((k + 7).alias("stop_id"), at(k, 9000.0).alias("lat"), F.lit(151.0).alias("lon"))
    began = time.time()
    got = {r.school_code: r for r in stops.near(a, b).collect()}
    assert time.time() - began < 30
    distance = lambda y, lat: 2 * stops.EARTH_M * math.asin(math.sin(math.radians(abs(y - lat)) / 2))
    for s in (0, 1, 39, 59_999):
        d = {p: distance((s % 40) / 8000, p / 9000) for p in range(40)}
        low = min(d, key=d.get)
        assert got[s].nearest_stop_id == low + 7 and abs(got[s].nearest_m - d[low]) < 0.01
        assert got[s].n_within == 1500 * sum(x <= 300 for x in d.values())
    assert len(got) == 60_000


def test_nearest_stop_beyond_the_counted_ones(spark):
    """Every ring of the search, its ends and points that meet no stop; equal points, equal schools and equally near stops."""
    degree = math.pi * stops.EARTH_M / 180
    far = [10, 299.9, 300.1, 599, 601, 1199, 1201, 1999.9, 2000.1, 5000]
    a = spark.createDataFrame([(k, 0.5 * k, 10.0) for k in range(len(far))] + [(0, 0.5, 10.0), (90, None, 10.0), (91, 0.0, 10.0)], "school_code int, latitude double, longitude double")
    b = spark.createDataFrame([(100 + 2 * k + c, 0.5 * k + m / degree, 10.0) for k, m in enumerate(far) for c in (1, 0)], "stop_id int, lat double, lon double")
    got = {r.school_code: r for r in stops.near(a, b).collect()}
    assert [got[k].nearest_stop_id for k in range(1, len(far))] == [100 + 2 * k if m <= 2000 else None for k, m in enumerate(far)][1:]
    assert (got[0].nearest_stop_id, got[0].n_within) == (100, 4) and (got[91].nearest_stop_id, got[91].n_within) == (100, 2)
    assert [got[k].n_within for k in range(1, len(far))] == [2 * (m <= 300) for m in far[1:]] and got[90].n_within == 0 and got[90].nearest_stop_id is None


def test_schools_table_is_what_silver_reads():
    assert {"school_code", *silver.VALUES} <= set(SCHOOLS.names)


def test_snapshots_stay_and_old_parts_go(place):
    store, data = place
    put(data, "rent_data", "rent_id\n1\n")
    bronze.run(store, str(data), ["rent_data"])
    before = store.read(RENTS)
    for k in range(2, 8):
        put(data, "rent_data", f"rent_id\n{k}\n")
        bronze.run(store, str(data), ["rent_data"])
        if k == 3:
            assert [r.rent_id for r in before.collect()] == [1]  # a query that began before two loads still has its rows
    assert rents(store) == [(7, None)]
    assert len(store.versions(RENTS)) == 3 and len(store.files.names(f"{store.root}/bronze/rent_data/parts")) == 3


def test_of_two_writers_none_is_lost(place):
    store, data = place
    (data / "raw").mkdir(parents=True)
    sources = {n: Source(n, RENTS, f"raw/{n}.csv", "csv") for n in "abc"}
    for n, ids in (("a", "1"), ("b", "2"), ("c", "2")):
        (data / f"raw/{n}.csv").write_text(f"rent_id\n{ids}\n")
    bronze.run(store, str(data), ["a"], sources)
    plain, late = store._commit, []

    def overtaken(table, m):
        if not late:
            late.append(1)
            bronze.run(Store(store.spark, store.root), str(data), ["b"], sources)
        return plain(table, m)

    store._commit = overtaken
    (data / "raw/a.csv").write_text("rent_id\n3\n")
    bronze.run(store, str(data), ["a"], sources)
    assert [r[0] for r in rents(store)] == [2, 3]
    late.clear()
    store.remove(RENTS, sources["b"].path)
    late.clear()
    with pytest.raises(ConstraintError, match="other files"):
        bronze.run(store, str(data), ["c"], sources)  # b, with the same key, comes in between
    assert [r[0] for r in rents(store)] == [2, 3]


def test_reset_and_purge(place, monkeypatch):
    from orewright import manage

    store, data = place
    put(data, "rent_data", "rent_id\n1\n")
    bronze.run(store, str(data), ["rent_data"])
    args = ["rent_data", "--warehouse", store.root]
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert manage.main(["reset", *args]) == 1 and store.exists(RENTS)
    assert manage.main(["reset", "--yes", *args]) == 0 and not store.exists(RENTS)
    bronze.run(store, str(data), ["rent_data"])
    assert manage.main(["purge", "--yes", "--warehouse", store.root]) == 0 and not store.files.exists(store.root)
