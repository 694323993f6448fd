"""GeoJSON, GeoPackage, KML and Shapefile.

Readers take a path or glob and parse files in parallel, one task a file (line-delimited GeoJSON is split further).
Writers make one file, as these formats need, on the driver's machine; they are for interchange, not for bulk.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from larkspur.errors import InvalidGeometry
from larkspur.functions import geo
from larkspur.geometry import crs
from larkspur.geometry.measure import inside, shoelace
from larkspur.geometry.model import KINDS, Geometry, bounds, closed, read_wkb, write_wkb, xy
from larkspur.sources.tabular import where_sql

# GeoJSON


def from_geojson(value: dict | None) -> Geometry | None:
    if value is None:
        return None
    kind = value.get("type")
    if kind not in KINDS:
        raise InvalidGeometry(f"unknown kind {kind}")
    if kind == "GeometryCollection":
        parts = [from_geojson(g) for g in value["geometries"]]
        return Geometry(kind, parts, any(p.z for p in parts))
    c = value["coordinates"]
    depth = {"Point": 0, "LineString": 0, "MultiPoint": 0, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 2}[kind]
    build = lambda x, d: (xy(x) if len(x) else np.zeros((0, 2))) if d == 0 else [build(y, d - 1) for y in x]
    made = build([c] if kind == "Point" and c else c, depth)
    parts = [made[i : i + 1] for i in range(len(made))] if kind == "MultiPoint" else [made] if depth == 0 else made
    g = Geometry(kind, parts)
    g.z = next((a.shape[1] == 3 for a in g.arrays() if len(a)), False)
    return g


def to_geojson(g: Geometry) -> dict:
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [to_geojson(x) for x in g.parts]}
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else [plain(y) for y in x]
    c = plain(g.parts)
    if g.kind == "Point":
        c = c[0][0] if c and c[0] else []
    elif g.kind == "LineString":
        c = c[0] if c else []
    elif g.kind == "MultiPoint":
        c = [p[0] for p in c]
    return {"type": g.kind, "coordinates": c}


ORDER = [BooleanType(), LongType(), DoubleType(), StringType()]


def value_kind(v) -> int:
    return 0 if isinstance(v, bool) else 1 if isinstance(v, int) else 2 if isinstance(v, float) else 3


def promoted(kinds: set[int]) -> int:
    """The type that all values fit: booleans mix with nothing but text."""
    return kinds.pop() if len(kinds) == 1 else 2 if kinds <= {1, 2} else 3


def features(text: str, lines: bool) -> Iterator[dict]:
    if lines:
        yield from (json.loads(x) for x in text.splitlines() if x.strip())
        return
    whole = json.loads(text)
    yield from whole["features"] if whole["type"] == "FeatureCollection" else [whole]


def raw_features(spark: SparkSession, path: str) -> DataFrame:
    """feature string: one JSON text per feature."""
    if re.search(r"\.(geojsonl|ndjson|jsonl)(\.\w+)?$", path):
        return spark.read.text(path).filter("trim(value) <> ''").withColumnRenamed("value", "feature")

    def split(batches):
        for t in batches:
            yield pd.DataFrame({"feature": [json.dumps(f) for text in t["value"] for f in features(text, False)]})

    return spark.read.text(path, wholetext=True).mapInPandas(split, "feature string")


def read_geojson(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One row per feature: a column per property, then ``geometry``. Without a schema, the types are gathered in a pass of their own."""
    rows = raw_features(spark, path)
    if schema is None:

        def scan(batches):
            for t in batches:
                found = {(k, value_kind(v)) for text in t["feature"] for k, v in (json.loads(text).get("properties") or {}).items() if v is not None}
                names = {k for text in t["feature"] for k in (json.loads(text).get("properties") or {})}
                yield pd.DataFrame([*found, *((k, -1) for k in names)], columns=["name", "kind"])

        kinds: dict[str, set[int]] = {}
        for name, kind in rows.mapInPandas(scan, "name string, kind int").distinct().collect():  # a schema's worth
            kinds.setdefault(name, set()).add(kind)
        schema = StructType([StructField(n, ORDER[promoted(k - {-1})] if k - {-1} else StringType()) for n, k in sorted(kinds.items())])
    out = StructType([*schema.fields, geo.geometry_field("geometry")])
    names, texts = schema.names, {f.name for f in schema.fields if isinstance(f.dataType, StringType)}

    def value(name: str, v):
        return v if v is None or name not in texts or isinstance(v, str) else json.dumps(v)

    def parse(batches):
        for t in batches:
            made = []
            for f in map(json.loads, t["feature"]):
                properties, g = f.get("properties") or {}, from_geojson(f.get("geometry"))
                made.append([*(value(n, properties.get(n)) for n in names), None if g is None else write_wkb(g)])
            yield pd.DataFrame(made, columns=[*names, "geometry"]).astype(object)

    return rows.mapInPandas(parse, out).select(*names, geo.tag("geometry", "geometry"))


def feature_json(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """feature string, built from the other columns as properties."""

    @F.pandas_udf("string")
    def shape(raw: pd.Series) -> pd.Series:
        return pd.Series(["null" if b is None else json.dumps(to_geojson(read_wkb(b))) for b in raw], dtype=object)

    others = [c for c in df.columns if c != geometry]
    properties = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    return df.select(F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), shape(geometry), F.lit("}")).alias("feature"))


def write_geojsonl(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """A folder of line-delimited features, written in parallel."""
    feature_json(df, geometry).write.text(path)


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(feature_json(df, geometry).toLocalIterator()):
            out.write((",\n" if i else "\n") + row[0])
        out.write("\n]}\n")


# files whole


def parsed_files(spark: SparkSession, path: str, parse, schema: StructType) -> DataFrame:
    """``parse(bytes) -> rows`` over each file."""

    def work(batches):
        for t in batches:
            for raw in t["content"]:
                yield pd.DataFrame(list(parse(bytes(raw))), columns=schema.names).astype(object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, schema)


# KML


def kml_root(raw: bytes) -> ElementTree.Element:
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    if b"<!DOCTYPE" in raw[:2000] or b"<!ENTITY" in raw:
        raise InvalidGeometry("KML with document types is refused")
    root = ElementTree.fromstring(raw)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def kml_geometry(e: ElementTree.Element | None) -> Geometry | None:
    if e is None:
        return None
    coords = lambda x: xy([[float(v) for v in c.split(",")] for c in (x.findtext("coordinates") or "").split()])
    if e.tag in ("Point", "LineString", "LinearRing"):
        a = coords(e)
        return Geometry("Point" if e.tag == "Point" else "LineString", [a], a.shape[1] == 3)
    if e.tag == "Polygon":
        rings = [coords(r) for r in [*e.findall("outerBoundaryIs/LinearRing"), *e.findall("innerBoundaryIs/LinearRing")]]
        return Geometry("Polygon", rings, rings[0].shape[1] == 3)
    parts = [g for g in map(kml_geometry, e) if g]
    kinds = {p.kind for p in parts}
    if len(kinds) == 1 and (kind := kinds.pop()) in KINDS[:3]:
        return Geometry(f"Multi{kind}", [p.parts if kind == "Polygon" else p.parts[0] for p in parts], parts[0].z)
    return Geometry("GeometryCollection", parts, any(p.z for p in parts))


SHAPES = ("Point", "LineString", "LinearRing", "Polygon", "MultiGeometry")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """KML or KMZ: a row per placemark with name, description, extended data as text columns, and geometry."""

    def placemarks(raw: bytes):
        for p in kml_root(raw).iter("Placemark"):
            data = {d.get("name"): d.findtext("value") for d in p.iter("Data")} | {d.get("name"): d.text for d in p.iter("SimpleData")}
            g = kml_geometry(next((e for e in p if e.tag in SHAPES), None))
            yield p.findtext("name"), p.findtext("description"), data, None if g is None else write_wkb(g)

    schema = StructType.fromDDL("name string, description string, data map<string, string>, geometry binary")
    df = parsed_files(spark, path, placemarks, schema)
    keys = sorted(r[0] for r in df.select(F.explode(F.map_keys("data"))).distinct().collect())  # a schema's worth
    return df.select("name", "description", *(F.col("data")[k].alias(k) for k in keys if k not in ("name", "description", "geometry")), geo.tag("geometry", "geometry"))


def to_kml(g: Geometry) -> str:
    path = lambda a: "<coordinates>" + " ".join(",".join(map(repr, r)) for r in a.tolist()) + "</coordinates>"
    if g.kind in ("Point", "LineString"):
        return f"<{g.kind}>{path(g.parts[0])}</{g.kind}>"
    if g.kind == "Polygon":
        side = lambda name, r: f"<{name}BoundaryIs><LinearRing>{path(r)}</LinearRing></{name}BoundaryIs>"
        return "<Polygon>" + "".join(side("inner" if i else "outer", r) for i, r in enumerate(g.parts)) + "</Polygon>"
    return "<MultiGeometry>" + "".join(map(to_kml, g.singles())) + "</MultiGeometry>"


def write_kml(df: DataFrame, path: str, geometry: str = "geometry", name: str = "name") -> None:
    """KML, or KMZ by the path's suffix. Coordinates must be degrees."""
    rows = ['<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>']
    for r in df.toLocalIterator():
        data = "".join(f'<Data name="{escape(k, {chr(34): "&quot;"})}"><value>{escape(str(v))}</value></Data>' for k, v in r.asDict().items() if k not in (geometry, name) and v is not None)
        title = f"<name>{escape(str(r[name]))}</name>" if name in df.columns and r[name] is not None else ""
        rows.append(f"<Placemark>{title}<ExtendedData>{data}</ExtendedData>{to_kml(read_wkb(bytes(r[geometry]))) if r[geometry] else ''}</Placemark>")
    text = "\n".join(rows) + "\n</Document></kml>\n"
    if path.endswith(".kmz"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("doc.kml", text)
    else:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)


# Shapefile; fixed values: the kinds' codes, with heights 10 more

SHP = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def shp_shapes(raw: bytes) -> Iterator[bytes | None]:
    if struct.unpack_from(">i", raw, 0)[0] != 9994:
        raise InvalidGeometry("not a shapefile")
    at = 100
    while at + 8 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        at += 8
        (code,) = struct.unpack_from("<i", raw, at)
        z = code in (11, 13, 15, 18)
        kind = SHP.get(code - 10 if z else code)
        if code and kind is None:
            raise InvalidGeometry(f"shape type {code}")
        if not code:
            yield None
        elif kind == "Point":
            yield write_wkb(Geometry("Point", [np.frombuffer(raw, "<f8", 3 if z else 2, at + 4).reshape(1, -1)], z))
        else:
            parts, n = (1, struct.unpack_from("<i", raw, at + 36)[0]) if kind == "MultiPoint" else struct.unpack_from("<2i", raw, at + 36)
            head = at + (40 if kind == "MultiPoint" else 44)
            starts = [0] if kind == "MultiPoint" else list(struct.unpack_from(f"<{parts}i", raw, head))
            begin = head + (0 if kind == "MultiPoint" else 4 * parts)
            c = np.frombuffer(raw, "<f8", 2 * n, begin).reshape(n, 2)
            if z:
                c = np.column_stack([c, np.frombuffer(raw, "<f8", n, begin + 16 * n + 16)])
            paths = [c[a:b] for a, b in zip(starts, [*starts[1:], n])]
            if kind == "MultiPoint":
                g = Geometry(kind, [c[i : i + 1] for i in range(n)], z)
            elif kind == "LineString":
                g = Geometry(kind, paths, z) if parts == 1 else Geometry("MultiLineString", paths, z)
            else:
                polygons = ring_sets(paths)
                g = Geometry("Polygon", polygons[0], z) if len(polygons) == 1 else Geometry("MultiPolygon", polygons, z)
            yield write_wkb(g)
        at += 2 * words


def ring_sets(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Clockwise rings are exteriors; others are holes of the one that they lie in."""
    outer = [[r] for r in rings if shoelace(r[:, :2]) <= 0]
    for h in (r for r in rings if shoelace(r[:, :2]) > 0):
        home = next((p for p in outer if inside(h[:1, :2], [closed(p[0][:, :2])]).any()), None)
        outer.append([h]) if home is None else home.append(h)
    return outer


def dbf_fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(name, kind, width, decimals) of each field."""
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return fields


def dbf_table(raw: bytes) -> tuple[list[tuple[str, str, int, int]], list[list]]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, rows = dbf_fields(raw), []
    for i in range(n):
        row, p = [], head + i * size + 1
        for _, kind, width, decimals in fields:
            text = raw[p : p + width].decode("utf-8", "replace").strip(" \0")
            p += width
            if kind == "L":
                row.append({"T": True, "Y": True, "F": False, "N": False}.get(text.upper()))
            elif kind in "NF":
                row.append(None if not text or set(text) <= {"*"} else float(text) if decimals or kind == "F" else int(text))
            else:
                row.append(text or None)
        rows.append(row)
    return fields, rows


def guess_epsg(prj: str) -> int:
    if found := re.search(r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', prj.strip()):
        return int(found[1])
    if zone := re.search(r"UTM[_ ]zone[_ ](\d+)([NS])", prj, re.I):
        return (32600 if zone[2].upper() == "N" else 32700) + int(zone[1])
    return 3857 if "Mercator" in prj and "Transverse" not in prj else 4326


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of one .shp; .dbf and .prj may lie beside it. Read in one task, which the format's offsets ask for; the driver reads the .dbf's header only."""
    stem = path.removesuffix(".shp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    beside = [end for end in (".dbf", ".prj") if store.exists(hadoop(stem + end))]
    fields = dbf_fields(dbf_header(spark, store, hadoop(stem + ".dbf"))) if ".dbf" in beside else []
    prj = spark.read.text(stem + ".prj", wholetext=True).first() if ".prj" in beside else None
    kind = lambda t, d: BooleanType() if t == "L" else DoubleType() if t == "F" or (t == "N" and d) else LongType() if t == "N" else StringType()
    schema = StructType([*(StructField(n, kind(t, d)) for n, t, _, d in fields), StructField("geometry", BinaryType())])

    def join(batches):
        held = {p.rsplit(".", 1)[1]: bytes(c) for t in batches for p, c in zip(t["path"], t["content"])}
        if held:
            shapes = list(shp_shapes(held["shp"]))
            rows = [[*r, g] for r, g in zip(dbf_table(held["dbf"])[1] if fields else [[]] * len(shapes), shapes)]
            yield pd.DataFrame(rows, columns=schema.names).astype(object)

    files = spark.read.format("binaryFile").load([f"{stem}.shp", *([f"{stem}.dbf"] if fields else [])])
    df = files.select("path", "content").coalesce(1).mapInPandas(join, schema)
    return df.select(*schema.names[:-1], geo.tag("geometry", "geometry", epsg=guess_epsg(prj[0]) if prj else 4326))


def dbf_header(spark: SparkSession, store, path) -> bytes:
    """The first bytes of a .dbf, to the end of its list of fields."""
    stream = store.open(path)
    try:
        head = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, 32))
        size = int.from_bytes(head[8:10], "little")
        return head + bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size - 32))
    finally:
        stream.close()


def write_shapefile(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """.shp, .shx, .dbf and .prj; all geometries of one kind."""
    stem = path.removesuffix(".shp")
    rows = [r.asDict() for r in df.toLocalIterator()]
    shapes = [None if r[geometry] is None else read_wkb(bytes(r[geometry])) for r in rows]
    single = {"MultiLineString": "LineString", "MultiPolygon": "Polygon"}
    kinds = {single.get(g.kind, g.kind) for g in shapes if g}
    if len(kinds) > 1:
        raise InvalidGeometry(f"a shapefile holds one kind, not {sorted(kinds)}")
    z = any(g.z for g in shapes if g)
    code = next((c for c, k in SHP.items() if k in kinds), 0)
    code += 10 * z if code else 0
    box, records = None, []
    for g in shapes:
        if g is None:
            records.append(struct.pack("<i", 0))
            continue
        b = bounds(g)
        box = b if box is None else (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
        full = [a if a.shape[1] == 3 or not z else np.column_stack([a, np.zeros(len(a))]) for a in g.arrays()]
        if g.kind == "Point":
            records.append(struct.pack("<i", code) + full[0].astype("<f8").tobytes() + (struct.pack("<d", 0) if z else b""))
            continue
        if kinds == {"Polygon"}:
            polygons = [g.parts] if g.kind == "Polygon" else g.parts
            first = {id(p[0]) for p in polygons}
            turned = [a if (shoelace(a[:, :2]) < 0) == (id(o) in first) else a[::-1] for a, o in zip(full, g.arrays())]
            full = turned
        c = np.concatenate(full)
        starts = np.cumsum([0, *map(len, full)])[:-1]
        head = struct.pack("<i4d", code, *b) + (struct.pack("<i", len(c)) if kinds == {"MultiPoint"} else struct.pack(f"<2i{len(full)}i", len(full), len(c), *starts))
        tail = struct.pack("<2d", c[:, 2].min(), c[:, 2].max()) + c[:, 2].astype("<f8").tobytes() + struct.pack("<2d", 0, 0) + np.zeros(len(c)).tobytes() if z else b""
        records.append(head + c[:, :2].astype("<f8").tobytes() + tail)
    header = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, code, *(box or (0,) * 4), 0, 0, 0, 0)
    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx:
        shp.write(header(100 + sum(8 + len(r) for r in records)))
        shx.write(header(100 + 8 * len(records)))
        at = 100
        for i, r in enumerate(records):
            shp.write(struct.pack(">2i", i + 1, len(r) // 2) + r)
            shx.write(struct.pack(">2i", at // 2, len(r) // 2))
            at += 8 + len(r)
    fields = [f for f in df.schema.fields if f.name != geometry]
    spec = []
    for f in fields:
        if isinstance(f.dataType, BooleanType):
            spec.append(("L", 1, 0, lambda v: "T" if v else "F"))
        elif isinstance(f.dataType, StringType):
            width = min(254, max([1, *(len(str(r[f.name]).encode()) for r in rows if r[f.name] is not None)]))
            spec.append(("C", width, 0, str))
        elif f.dataType.typeName() in ("double", "float"):
            spec.append(("N", 24, 15, lambda v: f"{v:.15g}"[:24]))
        else:
            spec.append(("N", 20, 0, str))
    with open(f"{stem}.dbf", "wb") as out:
        size = 1 + sum(s[1] for s in spec)
        out.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(spec), size))
        for f, (kind, width, decimals, _) in zip(fields, spec):
            out.write(struct.pack("<11sc4xBB14x", f.name.encode()[:10], kind.encode(), width, decimals))
        out.write(b"\r")
        for r in rows:
            cells = [("" if r[f.name] is None else show(r[f.name])).encode()[:w] for f, (_, w, _, show) in zip(fields, spec)]
            out.write(b" " + b"".join(c.rjust(s[1]) if s[0] == "N" else c.ljust(s[1]) for c, s in zip(cells, spec)))
        out.write(b"\x1a")
    with open(f"{stem}.prj", "w") as out:
        out.write(f'AUTHORITY["EPSG","{geo.epsg_of(df, geometry)}"]]')


# GeoPackage


def gpkg_blob(g: Geometry, epsg: int) -> bytes:
    b = bounds(g)
    flags = 1 | (2 if b else 0x10)
    return b"GP" + struct.pack("<BBi", 0, flags, epsg) + (struct.pack("<4d", b[0], b[2], b[1], b[3]) if b else b"") + write_wkb(g)


def from_gpkg_blob(raw: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage geometry."""
    if raw is None:
        return None
    if raw[:2] != b"GP":
        raise InvalidGeometry("not a GeoPackage geometry")
    return raw[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[raw[3] >> 1 & 7] :]


def gpkg_layers(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def gpkg_aggregate(path: str, layer: str, kind: str, name: str | None = None) -> float | int | None:
    """sum, avg, min, max or count, worked out inside the file's engine."""
    if kind.lower() not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"unknown aggregate {kind}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute(f"SELECT {kind}({quoted(name) if name else '*'}) FROM {quoted(layer)}").fetchone()[0]


AFFINITY = [("INT", LongType()), ("BOOL", BooleanType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("NUM", DoubleType()), ("BLOB", BinaryType())]


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, columns: list[str] | None = None, where: list[tuple[str, str, object]] | None = None, parts: int = 8) -> DataFrame:
    """A layer of a file that all executors can open, read by ranges of row ids; columns and ``where`` go into the query."""
    layer = layer or gpkg_layers(path)[0]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        table = db.execute(f"PRAGMA table_info({quoted(layer)})").fetchall()
        shape, epsg = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", [layer]).fetchone()
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(layer)}").fetchone()
    keys = {r[1] for r in table if r[5]}
    chosen = [r for r in table if (columns is None and r[1] not in keys) or (columns is not None and r[1] in columns)]
    kind = lambda r: BinaryType() if r[1] == shape else next((t for k, t in AFFINITY if k in r[2].upper()), StringType())
    schema = StructType([StructField(r[1], kind(r)) for r in chosen])
    names, condition = schema.names, where_sql(where or [])
    low, high = low or 0, high or 0
    step = max(1, -(-(high - low + 1) // parts))

    def read(batches):
        for t in batches:
            for begin in t["begin"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(layer)} WHERE rowid >= ? AND rowid < ?" + (f" AND {condition[0]}" if condition[0] else ""), [int(begin), int(begin) + step, *condition[1]]).fetchall()
                df = pd.DataFrame(rows, columns=names).astype(object)
                if shape in names:
                    df[shape] = [from_gpkg_blob(b) for b in df[shape]]
                for f in schema.fields:
                    if isinstance(f.dataType, BooleanType):
                        df[f.name] = [None if v is None else bool(v) for v in df[f.name]]
                yield df.where(df.notna(), None)

    ranges = spark.createDataFrame([(b,) for b in range(low, high + 1, step)], "begin long").repartition(parts)
    df = ranges.mapInPandas(read, schema)
    return df.select(*(geo.tag(c, c, epsg=epsg) if c == shape else F.col(c) for c in names))


def write_gpkg(df: DataFrame, path: str, layer: str, geometry: str = "geometry", index: bool = True, replace: bool = False) -> None:
    """A layer of a GeoPackage file, with a box index unless it is declined."""
    epsg = geo.epsg_of(df, geometry)
    kinds = {"boolean": "BOOLEAN", "long": "INTEGER", "integer": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    db = sqlite3.connect(path)
    try:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.executescript(
            """CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT DEFAULT CURRENT_TIMESTAMP, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
            CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
            CREATE TABLE IF NOT EXISTS gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);"""
        )
        if replace:
            remove_layer(db, layer)
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", [f"EPSG:{epsg}", epsg, epsg, json.dumps(crs.projjson(epsg))])
        fields = ", ".join(f"{quoted(f.name)} {kinds.get(f.dataType.typeName(), 'TEXT') if f.name != geometry else 'GEOMETRY'}" for f in df.schema.fields)
        db.execute(f"CREATE TABLE {quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, {fields})")
        insert = f"INSERT INTO {quoted(layer)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"
        box, boxes = None, []
        for fid, r in enumerate(df.toLocalIterator(), 1):
            g = None if r[geometry] is None else read_wkb(bytes(r[geometry]), epsg)
            db.execute(insert, [gpkg_blob(g, epsg) if c == geometry and g else r[c] for c in df.columns])
            if g and (b := bounds(g)):
                boxes.append((fid, b[0], b[2], b[1], b[3]))
                box = b if box is None else (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", [layer, layer, *(box or (None,) * 4), epsg])
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 2, 0)", [layer, geometry, epsg])
        if index:
            name = f"rtree_{layer}_{geometry}"
            db.execute(f"CREATE VIRTUAL TABLE {quoted(name)} USING rtree(id, minx, maxx, miny, maxy)")
            db.executemany(f"INSERT INTO {quoted(name)} VALUES (?, ?, ?, ?, ?)", boxes)
            db.execute("INSERT INTO gpkg_extensions VALUES (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec/#extension_rtree', 'write-only')", [layer, geometry])
        db.commit()
    finally:
        db.close()


def remove_layer(db: sqlite3.Connection, layer: str) -> None:
    shape = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [layer]).fetchone()
    if shape:
        db.execute(f"DROP TABLE IF EXISTS {quoted(f'rtree_{layer}_{shape[0]}')}")
    db.execute(f"DROP TABLE IF EXISTS {quoted(layer)}")
    for table in ("gpkg_contents", "gpkg_geometry_columns", "gpkg_extensions"):
        db.execute(f"DELETE FROM {table} WHERE table_name = ?", [layer])
