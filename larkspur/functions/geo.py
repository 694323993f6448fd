"""Geometry functions on WKB columns, as Arrow-batched functions over the plain kernels.

Null geometries give null. The coordinate system is an argument, since WKB doesn't carry it; measures of
points alone are better written with coordinates (``larkspur.functions.expr.haversine``), which stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from larkspur.errors import UnsupportedCRS
from larkspur.functions.expr import METRES, column
from larkspur.geometry import batch, boolean, crs, measure, transform
from larkspur.geometry.model import Geometry, bounds as box_of, multipolygon, point, read_wkb, read_wkt, write_wkb, write_wkt

#: Keys of a geometry column's metadata.
TYPE_KEY, EPSG_KEY = "geometry_type", "crs_epsg"


def geometry_field(name: str, kind: str = "Geometry", epsg: int = 4326) -> StructField:
    return StructField(name, BinaryType(), True, {TYPE_KEY: kind, EPSG_KEY: epsg})


def tag(c: Column | str, name: str, kind: str = "Geometry", epsg: int = 4326) -> Column:
    """``c`` as a geometry column: its kind and system go with it as metadata."""
    return column(c).alias(name, metadata={TYPE_KEY: kind, EPSG_KEY: epsg})


def epsg_of(df: DataFrame, name: str, default: int = 4326) -> int:
    return int(df.schema[name].metadata.get(EPSG_KEY, default))


def is_geometry(df: DataFrame, name: str) -> bool:
    return TYPE_KEY in df.schema[name].metadata


def one(work: Callable[[Geometry], object], kind: str, epsg: int) -> Callable[[Column | str], Column]:
    @F.pandas_udf(kind)
    def run(raw: pd.Series) -> pd.Series:
        # a geometry that stands on many rows of a batch is worked on once
        known = cache(lambda b: work(read_wkb(b, epsg)))
        return pd.Series([None if b is None else known(bytes(b)) for b in raw], dtype=object)

    return lambda c: run(column(c))


def two(work: Callable[[Geometry, Geometry], object], kind: str, epsg: int) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        # a geometry that stands on many rows (a join's) is read once, a pair is worked on once
        read = lru_cache(1024)(lambda b: read_wkb(b, epsg))
        known = cache(lambda a, b: work(read(a), read(b)))
        return pd.Series([None if a is None or b is None else known(bytes(a), bytes(b)) for a, b in zip(left, right)], dtype=object)

    return lambda a, b: run(column(a), column(b))


def wkb(g: Geometry | None) -> bytes | None:
    return None if g is None else write_wkb(g)


# construction and encodings


def points_from_xy(x: Column | str, y: Column | str, z: Column | str | None = None) -> Column:
    """WKB points, built as one block of records; null with any null."""
    width = 2 if z is None else 3

    @F.pandas_udf("binary")
    def run(table: pd.DataFrame) -> pd.Series:
        kind = np.dtype([("order", "u1"), ("code", "<u4"), ("c", "<f8", (width,))])
        out = np.zeros(len(table), kind)
        out["order"], out["code"], out["c"] = 1, 1 if width == 2 else 1001, table.to_numpy(float)
        raw, n = out.tobytes(), kind.itemsize
        absent = table.isna().any(axis=1).to_numpy()
        return pd.Series([None if gone else raw[i * n : (i + 1) * n] for i, gone in enumerate(absent)], dtype=object)

    return run(F.struct(*(column(c).cast("double").alias(f"c{i}") for i, c in enumerate([x, y] + ([z] if z is not None else [])))))


def from_wkt(c: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        known = cache(lambda t: write_wkb(read_wkt(t)))
        return pd.Series([known(t) if t else None for t in text], dtype=object)

    return run(column(c))


def to_wkt(c: Column | str) -> Column:
    return one(write_wkt, "string", 4326)(c)


def from_ewkb(c: Column | str) -> Column:
    return one(write_wkb, "binary", 4326)(c)


def to_ewkb(c: Column | str, epsg: int) -> Column:
    return one(lambda g: write_wkb(g, srid=True), "binary", epsg)(c)


def kind(c: Column | str) -> Column:
    """The kind's name, read off the header without parsing; little-endian WKB."""
    code = F.conv(F.hex(F.reverse(F.substring(column(c), 2, 4))), 16, 10).cast("int") % 1000
    names = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
    return F.get(F.array(*map(F.lit, names)), code - 1)


# measures


def by_rings(at_once: Callable[[batch.Rings], list], work: Callable[[Geometry], object], kind: str, epsg: int) -> Callable[[Column | str], Column]:
    """As ``one``, with the polygons of one ring in a batch worked on at once."""

    @F.pandas_udf(kind)
    def run(raw: pd.Series) -> pd.Series:
        held = raw.tolist()
        rings = batch.rings(held)
        out: list = [None] * len(held)
        for i, found in zip(rings.rows.tolist(), at_once(rings) if len(rings.rows) else []):
            out[i] = found
        done = set(rings.rows.tolist())
        for i, b in enumerate(held):
            if b is not None and i not in done:
                out[i] = work(read_wkb(b, epsg))
        return pd.Series(out, dtype=object)

    return lambda c: run(column(c))


def area(c: Column | str, epsg: int = 4326, unit: str = "m") -> Column:
    scale = METRES[unit] ** 2
    at_once = lambda r: ((r.spherical_area() if crs.geographic(epsg) else r.planar_area()) / scale).tolist()
    return by_rings(at_once, lambda g: measure.area(g, unit), "double", epsg)(c)


def length(c: Column | str, epsg: int = 4326, unit: str = "m") -> Column:
    if crs.geographic(epsg):
        return one(lambda g: measure.length(g, unit), "double", epsg)(c)
    return by_rings(lambda r: (r.planar_length() / METRES[unit]).tolist(), lambda g: measure.length(g, unit), "double", epsg)(c)


def centroid(c: Column | str, epsg: int = 4326) -> Column:
    def work(g: Geometry):
        m = measure.centroid(g)
        return None if m is None else write_wkb(point(*m, epsg=epsg))

    at_once = lambda r: [batch.POINT_HEAD + x.tobytes() for x in r.centroid().astype("<f8")]
    return by_rings(at_once, work, "binary", epsg)(c)


def bounds(c: Column | str) -> Column:
    """struct<min_x, min_y, max_x, max_y>; null for null and empty geometries. Points and single rings are read as one block."""

    @F.pandas_udf("min_x double, min_y double, max_x double, max_y double")
    def run(raw: pd.Series) -> pd.DataFrame:
        held = raw.tolist()
        out = np.full((len(held), 4), np.nan)
        rows, xy = batch.points(held)
        out[rows] = np.hstack([xy, xy])
        rings = batch.rings(held)
        if len(rings.rows):
            out[rings.rows] = rings.box()
        done = {*rows.tolist(), *rings.rows.tolist()}
        for i, b in enumerate(held):
            if b is not None and i not in done and (found := box_of(read_wkb(b))):
                out[i] = found
        return pd.DataFrame(out, columns=["min_x", "min_y", "max_x", "max_y"])

    b = run(column(c))
    return F.when(b["min_x"].isNotNull() & ~F.isnan(b["min_x"]), b)


def distance(a: Column | str, b: Column | str, epsg: int = 4326, unit: str = "m") -> Column:
    return two(lambda x, y: measure.distance(x, y, unit), "double", epsg)(a, b)


def is_empty(c: Column | str) -> Column:
    return one(lambda g: g.empty(), "boolean", 4326)(c)


def is_valid(c: Column | str) -> Column:
    return one(measure.valid, "boolean", 4326)(c)


def relate(predicate: str) -> Callable[[Column, Column], Column]:
    """intersects, contains, within, disjoint, touches, overlaps or crosses.

    Of points and polygons of one ring, the points that stand with a polygon are tested at once; those on its ring one by one.
    """
    work = measure.RELATIONS[predicate]
    # what a point strictly inside a polygon gives, with the point on the left and on the right
    given = {"intersects": (True, True), "disjoint": (False, False), "within": (True, False), "contains": (False, True)}

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        sides = [[None if b is None else bytes(b) for b in s] for s in (left, right)]
        out: list = [None] * len(left)
        todo = {i for i, (a, b) in enumerate(zip(*sides)) if a is not None and b is not None}
        for turn in (0, 1) if predicate in given else ():
            rows, c = batch.points(sides[turn])
            by_polygon: dict[bytes, list[int]] = {}
            for k, i in enumerate(rows.tolist()):
                if i in todo:
                    by_polygon.setdefault(sides[1 - turn][i], []).append(k)
            found = batch.rings(list(by_polygon))
            groups = list(by_polygon.values())
            for n, (start, count) in enumerate(zip(found.starts.tolist(), found.counts.tolist())):
                own = np.array(groups[int(found.rows[n])])
                within, edge = batch.inside(c[own], found.c[start : start + count])
                for i, hit, near in zip(rows[own].tolist(), within.tolist(), edge.tolist()):
                    if not near:
                        out[i] = given[predicate][turn] if hit else predicate == "disjoint"
                        todo.discard(i)
        read = lru_cache(1024)(lambda b: read_wkb(b, 4326))
        known = cache(lambda a, b: work(read(a), read(b)))
        for i in todo:
            out[i] = known(sides[0][i], sides[1][i])
        return pd.Series(out, dtype=object)

    return lambda a, b: run(column(a), column(b))


# transforms


def buffer(c: Column | str, by: float, segments: int = 32, square: bool = False) -> Column:
    return one(lambda g: write_wkb(transform.buffer(g, by, segments, square)), "binary", 3857)(c)


def simplify(c: Column | str, tolerance: float) -> Column:
    return one(lambda g: write_wkb(transform.simplify(g, tolerance)), "binary", 4326)(c)


def convex_hull(c: Column | str) -> Column:
    return one(lambda g: write_wkb(transform.convex_hull(g)), "binary", 4326)(c)


def envelope(c: Column | str) -> Column:
    return one(lambda g: write_wkb(transform.envelope(g)), "binary", 4326)(c)


def boolean_op(a: Column | str, b: Column | str, what: str, epsg: int) -> Column:
    """what: intersection, union, difference or symmetric_difference; projected coordinates only."""
    if crs.geographic(epsg):
        raise UnsupportedCRS("polygons are cut in projected coordinates")
    return two(lambda x, y: write_wkb(multipolygon(boolean.combine(x.polygons(), y.polygons(), what), epsg)), "binary", epsg)(a, b)


def to_crs(c: Column | str, source: int, target: int) -> Column:
    """Points and single rings of a batch are projected as one array."""

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        held = raw.tolist()
        out: list = [None] * len(held)
        moved = lambda x: x if source == target else crs.from_degrees(crs.to_degrees(x, source), target)
        rows, xy = batch.points(held)
        for i, x in zip(rows.tolist(), moved(xy).astype("<f8") if len(rows) else []):
            out[i] = batch.POINT_HEAD + x.tobytes()
        rings = batch.rings(held)
        ring = moved(rings.c).astype("<f8") if len(rings.rows) else rings.c
        for i, start, count in zip(rings.rows.tolist(), rings.starts.tolist(), rings.counts.tolist()):
            out[i] = batch.RING_HEAD + count.to_bytes(4, "little") + ring[start : start + count].tobytes()
        done = {*rows.tolist(), *rings.rows.tolist()}
        for i, b in enumerate(held):
            if b is not None and i not in done:
                out[i] = write_wkb(crs.project(read_wkb(b, source), target))
        return pd.Series(out, dtype=object)

    return run(column(c))


def mercator_xy(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Web Mercator of coordinate columns, without leaving the JVM."""
    bounded = F.greatest(F.least(column(lat), F.lit(crs.MERCATOR_LIMIT)), F.lit(-crs.MERCATOR_LIMIT))
    return F.radians(column(lon)) * crs.A, F.log(F.tan(F.lit(np.pi / 4) + F.radians(bounded) / 2)) * crs.A


def crosses_antimeridian(c: Column | str, epsg: int = 4326) -> Column:
    return one(lambda g: transform.antimeridian_crossings(g) > 0, "boolean", epsg)(c)


def split_at_antimeridian(c: Column | str, epsg: int = 4326) -> Column:
    return one(lambda g: write_wkb(transform.split_antimeridian(g)), "binary", epsg)(c)


def densify(c: Column | str, metres: float, epsg: int = 4326) -> Column:
    return one(lambda g: write_wkb(transform.densify(g, metres)), "binary", epsg)(c)


def explode(df: DataFrame, name: str) -> DataFrame:
    """A row for each part of a multi geometry; single ones and nulls pass."""

    @F.pandas_udf("array<binary>")
    def parts(raw: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else [write_wkb(g) for g in read_wkb(b).singles()] for b in raw], dtype=object)

    return df.select(*(F.explode_outer(parts(F.col(c))).alias(c, metadata=df.schema[c].metadata) if c == name else F.col(c) for c in df.columns))


# circles and ellipses: points as coordinate columns, in the JVM


def circle_contains(x: Column | str, y: Column | str, circle: transform.Circle) -> Column:
    return distance_to_circle(x, y, circle) <= 0


def distance_to_circle(x: Column | str, y: Column | str, circle: transform.Circle) -> Column:
    """Negative inside; metres where coordinates are degrees."""
    from larkspur.functions.expr import haversine

    if crs.geographic(circle.epsg):
        return haversine(F.lit(circle.y), F.lit(circle.x), y, x, "m") - circle.radius
    return F.hypot(column(x) - circle.x, column(y) - circle.y) - circle.radius


def ellipse_contains(x: Column | str, y: Column | str, e: transform.Ellipse) -> Column:
    dx, dy, cos, sin = column(x) - e.x, column(y) - e.y, float(np.cos(e.angle)), float(np.sin(e.angle))
    return F.pow((dx * cos + dy * sin) / e.a, 2) + F.pow((dy * cos - dx * sin) / e.b, 2) <= 1


def fit_circle(df: DataFrame, x: str, y: str, epsg: int = 3857) -> transform.Circle:
    """The least-squares circle of all points, from one pass of moments about the mean."""
    mx, my = df.agg(F.avg(x), F.avg(y)).first()
    u, v = F.col(x) - mx, F.col(y) - my
    z = u * u + v * v
    names = [("n", F.count("*")), ("uu", F.sum(u * u)), ("uv", F.sum(u * v)), ("vv", F.sum(v * v)), ("uz", F.sum(u * z)), ("vz", F.sum(v * z)), ("z", F.sum(z))]
    m = df.agg(*(c.alias(n) for n, c in names)).first()
    a, b = np.linalg.solve([[m["uu"], m["uv"]], [m["uv"], m["vv"]]], [m["uz"] / 2, m["vz"] / 2])
    return transform.Circle(float(a + mx), float(b + my), float(np.sqrt(a * a + b * b + m["z"] / m["n"])), epsg)


# aggregates


def total_bounds(df: DataFrame, name: str) -> tuple | None:
    b = df.select(bounds(name).alias("b")).agg(F.min("b.min_x"), F.min("b.min_y"), F.max("b.max_x"), F.max("b.max_y")).first()
    return None if b[0] is None else tuple(b)


def estimate_utm(df: DataFrame, name: str) -> int:
    """The UTM code for all geometries (in degrees) together."""
    return crs.estimate_utm(total_bounds(df, name))


def dissolve(df: DataFrame, name: str, keys: list[str] | None = None, parts: int = 32) -> DataFrame:
    """The union of all polygons, per key if any are named.

    Shares of a key that lie together are united in each batch, then over batches, then the key: polygons are dealt to shares by the strip of x that
    their middle lies in, of ``parts`` between the key's bounds, so that neighbours, which have edges to lose, meet early and the last
    union is of their outlines.
    """
    keys = keys or []
    heads = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields) if keys else ""

    def united(raw) -> bytes:
        return write_wkb(multipolygon(boolean.unary_union([p for b in raw if b is not None for p in read_wkb(b).polygons()]), 3857))

    def group(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | {name: united(t[name])}])

    def share_of(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return group(key[: len(keys)], t)

    def early(tables):
        for t in tables:
            rows = [dict(zip([*keys, "_part"], k)) | {name: united(g[name])} for k, g in t.groupby([*keys, "_part"], dropna=False, sort=False)]
            if rows:
                yield pd.DataFrame(rows)

    schema = f"{heads}{name} binary"
    box = df.select(*keys, name, bounds(name).alias("_b"))
    span = box.groupBy(*keys).agg(F.min("_b.min_x").alias("_low"), F.max("_b.max_x").alias("_high")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_low", "_high")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = box.join(span, same) if keys else box.crossJoin(F.broadcast(span))
    wide = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    strip = F.floor(((F.col("_b.min_x") + F.col("_b.max_x")) / 2 - F.col("_low")) / wide * parts)
    share = met.select(*keys, name, F.coalesce(F.least(strip, F.lit(parts - 1)), F.lit(0)).alias("_part"))
    share = share.mapInPandas(early, f"{heads}_part long, {name} binary")
    once = share.groupBy(*keys, "_part").applyInPandas(share_of, schema)
    return once.groupBy(*keys).applyInPandas(group, schema)
