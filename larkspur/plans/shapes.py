"""Queries of the geometry operators; shapes are made from keys, as the tables have none, so that closed forms state the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.operators import joins
from larkspur.plans.catalog import HAVERSINE, boxes, query

#: The boxes of ``catalog.boxes`` in SQL.
BOXES = "(SELECT s_suppkey, s_suppkey AS k, s_suppkey * 7 % 95 AS x, s_suppkey * 13 % 95 AS y, s_suppkey % 4 + 1 AS w FROM supplier)"


def square(x: Column, y: Column, side: Column) -> Column:
    at = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    ring = F.concat_ws(", ", at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side), at(x, y))
    return geo.from_wkt(F.concat(F.lit("POLYGON (("), ring, F.lit("))")))


def line(*coordinates: Column) -> Column:
    points = [F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in zip(coordinates[::2], coordinates[1::2])]
    return geo.from_wkt(F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", *points), F.lit(")")))


def keyed(t) -> DataFrame:
    return boxes(t).withColumn("k", F.col("s_suppkey").cast("int"))


@query(f"SELECT s_suppkey, k % 4 = 0 AS touches, k % 4 = 1 AS overlaps, k % 4 = 2 AS disjoint, k % 4 = 3 AS contains, k % 4 <> 2 AS intersects, k % 4 = 3 AS within, k % 2 = 0 AS crosses FROM {BOXES}")
def geo_relations(t):
    k, x, y, w = (F.col(c) for c in "kxyw")
    moved = F.when(k % 4 == 0, w * 1.0).when(k % 4 == 1, w / 2).when(k % 4 == 2, w * 3.0).otherwise(w / 4)
    up = F.when(k % 4 == 0, F.lit(0.0)).otherwise(moved)
    other = square(x + moved, y + up, F.when(k % 4 == 3, w / 2).otherwise(w * 1.0))
    level = F.when(k % 2 == 0, y + w / 2).otherwise(y + w * 2.0)
    df = keyed(t).withColumn("h", other).withColumn("l", line(x - 1.0, level, x + w + 1.0, level))
    named = ["touches", "overlaps", "disjoint", "contains", "intersects"]
    return df.select("s_suppkey", *(geo.relate(n)("g", "h").alias(n) for n in named), geo.relate("within")("h", "g").alias("within"), geo.relate("crosses")("l", "g").alias("crosses"))


@query(f"SELECT s_suppkey, round(sqrt(power(200 - x - w, 2) + power(300 - y - w, 2)), 6) AS away, round({HAVERSINE}, 6) AS km FROM (SELECT *, power(sin(radians(w) / 2), 2) + cos(radians(k % 80)) * cos(radians(k % 80 + w)) * power(sin(radians(w) / 2), 2) AS h FROM {BOXES})")
def geo_distance(t):
    df = keyed(t).withColumn("far", geo.points_from_xy(F.lit(200.0), F.lit(300.0)))
    df = df.withColumn("p", geo.points_from_xy("x", F.col("k") % 80)).withColumn("q", geo.points_from_xy(F.col("x") + F.col("w"), F.col("k") % 80 + F.col("w")))
    return df.select("s_suppkey", F.round(geo.distance("g", "far", 3857), 6).alias("away"), F.round(geo.distance("p", "q", 4326, "km"), 6).alias("km"))


@query(f"SELECT s_suppkey, round(power(6371.0088, 2) * radians(w) * (sin(radians(k % 80 + w)) - sin(radians(k % 80))), 3) AS km2, round(2 * 6371.0088 * radians(w), 4) AS line_km FROM {BOXES}")
def geo_spherical(t):
    k, x, w = F.col("k"), F.col("x"), F.col("w")
    df = keyed(t).withColumn("d", square(x, k % 80, w)).withColumn("l", line(x * 1.0, F.lit(0.0), x + w * 1.0, F.lit(0.0), x * 1.0, F.lit(0.0)))
    return df.select("s_suppkey", F.round(geo.area("d", 4326, "km"), 3).alias("km2"), F.round(geo.length("l", 4326, "km"), 4).alias("line_km"))


#: The meridian arc of WGS 84 by its series in the eccentricity.
E2 = "0.00669437999014"
ARC = f"6378137 * ((1 - {E2} / 4 - 3 * {E2} ** 2 / 64 - 5 * {E2} ** 3 / 256) * p - (3 * {E2} / 8 + 3 * {E2} ** 2 / 32 + 45 * {E2} ** 3 / 1024) * sin(2 * p) + (15 * {E2} ** 2 / 256 + 45 * {E2} ** 3 / 1024) * sin(4 * p) - 35 * {E2} ** 3 / 3072 * sin(6 * p))"


@query(f"SELECT s_suppkey, lon, lat, CASE WHEN lon = 15 THEN 500000.0 END AS easting, CASE WHEN lon = 15 THEN round(0.9996 * {ARC} / 1000, 2) END AS northing_km FROM (SELECT *, (15 + k % 5 - 2)::DOUBLE AS lon, (k * 13 % 80)::DOUBLE AS lat, radians(k * 13 % 80) AS p FROM {BOXES})")
def geo_utm(t):
    k = F.col("k")
    df = keyed(t).withColumn("u", geo.to_crs(geo.points_from_xy(k % 5 + 13, k * 13 % 80), 4326, 32633))
    df = df.withColumn("b", geo.bounds(geo.to_crs("u", 32633, 4326))).withColumn("u", geo.bounds("u"))
    on = k % 5 == 2
    return df.select("s_suppkey", F.round("b.min_x", 7).alias("lon"), F.round("b.min_y", 7).alias("lat"), F.when(on, F.round("u.min_x", 3)).alias("easting"), F.when(on, F.round(F.col("u.min_y") / 1000, 2)).alias("northing_km"))


@query(f"SELECT s_suppkey, (w * w)::DOUBLE AS hull, (4 * w)::DOUBLE AS hull_length, (w * w)::DOUBLE AS box, round(w * w + 2 * w + 4 * sin(pi() / 16), 6) AS rounded, ((w + 1) * (w + 1))::DOUBLE AS squared, (10 * w)::DOUBLE AS straight FROM {BOXES}")
def geo_transforms(t):
    """Hulls of points, envelopes of triangles, buffers of squares by 0.5 and lines with small bends taken out."""
    x, y, w = (F.col(c) for c in "xyw")
    at = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    corners = [at(x, y), at(x + w, y), at(x + w / 2, y + w / 3), at(x + w, y + w), at(x, y + w), at(x + w / 2, y + w)]
    points = geo.from_wkt(F.concat(F.lit("MULTIPOINT ("), F.concat_ws(", ", *corners), F.lit(")")))
    triangle = geo.from_wkt(F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(x, y), at(x + w, y), at(x, y + w), at(x, y)), F.lit("))")))
    bent = line(x * 1.0, y * 1.0, x + w * 3.0, y + 0.01, x + w * 7.0, y - 0.01, x + w * 10.0, y * 1.0)
    df = keyed(t).withColumn("hull", geo.convex_hull(points)).withColumn("box", geo.envelope(triangle))
    planar = lambda g: F.round(geo.area(g, 3857), 6)
    return df.select("s_suppkey", planar("hull").alias("hull"), geo.length("hull", 3857).alias("hull_length"), planar("box").alias("box"), planar(geo.buffer("g", 0.5)).alias("rounded"), planar(geo.buffer("g", 0.5, square=True)).alias("squared"), geo.length(geo.simplify(bent, 0.1), 3857).alias("straight"))


@query(f"SELECT s_suppkey, k % 2 = 0 AS crosses, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS parts FROM {BOXES}")
def geo_antimeridian(t):
    k = F.col("k")
    a = k % 80 + 100
    df = keyed(t).select("s_suppkey", line(a * 1.0, F.lit(10.0), F.when(k % 2 == 0, k % 10 - 170.0).otherwise(a - 50.0), F.lit(20.0)).alias("l"))
    parts = geo.explode(df.withColumn("p", geo.split_at_antimeridian("l")), "p")
    return parts.groupBy("s_suppkey", geo.crosses_antimeridian("l").alias("crosses")).agg(F.count("*").alias("parts"))


@query(f"SELECT s_suppkey, round(6371.0088 * radians(w), 4) AS km, (x + w)::DOUBLE AS ends FROM {BOXES}")
def geo_densify(t):
    x, w = F.col("x"), F.col("w")
    df = keyed(t).withColumn("l", geo.densify(line(x * 1.0, F.lit(0.0), x + w * 1.0, F.lit(0.0)), 20_000.0))
    return df.select("s_suppkey", F.round(geo.length("l", 4326, "km"), 4).alias("km"), geo.bounds("l")["max_x"].alias("ends"))


@query(f"SELECT (32601 + floor(((min(x) + max(x + w)) / 2.0 + 180) / 6))::INT AS epsg FROM {BOXES}")
def geo_estimate_utm(t):
    # one row, of four bounds
    df = keyed(t)
    return df.sparkSession.createDataFrame([(geo.estimate_utm(df, "g"),)], "epsg int")


@query(f"SELECT s_suppkey, 'POLYGON' AS kind, k % 3 <> 0 AS valid, (w * w)::DOUBLE AS area FROM {BOXES}")
def geo_encodings(t):
    """There and back by EWKB and WKT; a square whose corners are crossed is not valid."""
    x, y, w, k = (F.col(c) for c in "xywk")
    at = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    bow = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(x, y), at(x + w, y + w), at(x + w, y), at(x, y + w), at(x, y)), F.lit("))"))
    text = geo.to_wkt(geo.from_ewkb(geo.to_ewkb("g", 3857)))
    shape = geo.from_wkt(F.when(k % 3 == 0, bow).otherwise(text))
    return keyed(t).select("s_suppkey", F.split(text, " ")[0].alias("kind"), geo.is_valid(shape).alias("valid"), F.round(geo.area(geo.from_wkt(text), 3857), 6).alias("area"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT c_custkey, (c_custkey * 37) % 1000 / 10.0 + 0.05 AS px, (c_custkey * 91) % 1000 / 10.0 + 0.05 AS py FROM customer) JOIN (SELECT s_suppkey, s_suppkey * 7 % 95 AS a, s_suppkey * 13 % 95 AS b, s_suppkey % 4 + 1 AS w FROM supplier) ON px > a AND px < a + w AND py > b AND py < b + w")
def geo_join_polygons_points(t):
    k = F.col("c_custkey")
    points = t("customer").select("c_custkey", geo.points_from_xy((k * 37) % 1000 / 10.0 + 0.05, (k * 91) % 1000 / 10.0 + 0.05).alias("p"))
    return joins.sjoin(boxes(t).select("s_suppkey", "g"), points, "g", "p", "contains").select("s_suppkey", "c_custkey")


@query(f"SELECT a.s_suppkey, b.s_suppkey AS s_suppkey_right FROM {BOXES} a JOIN {BOXES} b ON a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w")
def geo_join_polygons(t):
    df = boxes(t).select("s_suppkey", "g")
    return joins.sjoin(df, df, "g", "g").select("s_suppkey", "s_suppkey_right")
