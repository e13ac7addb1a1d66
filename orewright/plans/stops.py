"""Stops near schools: how many within a radius, and the nearest. Beyond what the bronze and silver layers need.

Schools and stops at the same point are one point, met once. Both sides get the cells of a latitude-longitude grid as wide as
the radius; a point of schools meets the stops of its own and the eight cells around it, so the join is on equal cells. Stops
are counted and looked for within ``within`` first; points that have found none look again in grids of twice the width each,
up to ``reach``. So a search meets few more stops than the counted ones, however many lie within reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def stop_points(stops: DataFrame) -> DataFrame:
    """(stop_id, lat, lon) from the GeoJSON points of a stop table."""
    at = lambda k: F.get_json_object("geometry", f"$.coordinates[{k}]").cast("double")
    return stops.where(F.col("geometry_type") == "Point").select("stop_id", at(1).alias("lat"), at(0).alias("lon"))


def near(schools: DataFrame, stops: DataFrame, within: float = 300.0, reach: float = 2000.0, widest_lat: float = 60.0) -> DataFrame:
    """school_code, nearest_stop_id, nearest_m and n_within of every school (key and latitude, longitude).

    The nearest stop is null if none lies within ``reach``; equally near stops: the smallest id. Latitudes up to ``widest_lat``.
    """

    def cell(lat: Column, lon: Column, wide: float) -> tuple[Column, Column]:
        step = wide / EARTH_M * 180 / math.pi
        return F.floor(lat / step), F.floor(lon / (step / math.cos(math.radians(widest_lat))))

    a = schools.select("school_code", F.col("latitude").cast("double").alias("y"), F.col("longitude").cast("double").alias("x"))
    b = stops.groupBy("lat", "lon").agg(F.min(F.struct("stop_id")).alias("stop"), F.count(F.lit(1)).alias("n"))

    def met(points: DataFrame, looking: Column, wide: float) -> DataFrame:
        """Every point with the stops around it, if it is looking, else once without any."""
        cy, cx = cell(F.col("y"), F.col("x"), wide)
        nine = F.array(*[F.struct((cy + i).alias("cy"), (cx + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        around = points.withColumn("c", F.explode_outer(F.when(looking, nine))).select(*points.columns, "c.cy", "c.cx")
        sy, sx = cell(F.col("lat"), F.col("lon"), wide)
        held = b.select("lat", "lon", "stop", "n", sy.alias("cy"), sx.alias("cx"))
        return around.join(held, ["cy", "cx"], "left").withColumn("d", distance_m(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")))

    def nearest(wide: float) -> Column:
        return F.min(F.when(F.col("d") <= min(wide, reach), F.struct("d", "stop")))

    counted = F.coalesce(F.sum(F.when(F.col("d") <= within, F.col("n"))), F.lit(0)).alias("n_within")
    found, wide = met(a.select("y", "x").distinct(), F.lit(True), within).groupBy("y", "x").agg(nearest(within).alias("best"), counted), within
    while wide < reach:
        wide = min(2 * wide, reach)
        more = met(found, F.col("best").isNull(), wide).groupBy("y", "x")
        found = more.agg(F.coalesce(F.first("best"), nearest(wide)).alias("best"), F.first("n_within").alias("n_within"))
    each = a.join(found.withColumnsRenamed({"y": "py", "x": "px"}), F.col("y").eqNullSafe(F.col("py")) & F.col("x").eqNullSafe(F.col("px")))
    rows = each.groupBy("school_code").agg(F.min("best").alias("best"), F.sum("n_within").alias("n_within"))
    return rows.select("school_code", F.col("best.stop.stop_id").alias("nearest_stop_id"), F.col("best.d").alias("nearest_m"), "n_within")
