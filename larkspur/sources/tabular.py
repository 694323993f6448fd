"""Parquet (with GeoParquet metadata), CSV, dataclasses, JDBC and bucketed tables."""

from __future__ import annotations

import dataclasses
import json
import typing
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from larkspur.functions import geo
from larkspur.geometry import crs
from larkspur.operators.frame import select_cols

CODECS = {"uncompressed", "snappy", "gzip", "brotli", "lz4", "zstd"}


# Parquet


def geo_metadata(df: DataFrame) -> dict:
    """The GeoParquet 1.1 description of ``df``'s geometry columns."""
    columns = {f.name: {"encoding": "WKB", "geometry_types": [] if f.metadata[geo.TYPE_KEY] == "Geometry" else [f.metadata[geo.TYPE_KEY]], "crs": crs.projjson(f.metadata[geo.EPSG_KEY])} for f in df.schema.fields if geo.TYPE_KEY in f.metadata}
    return {"version": "1.1.0", "primary_column": next(iter(columns)), "columns": columns} if columns else {}


def parse_geo_metadata(raw: str | bytes) -> dict[str, dict]:
    """Column metadata by column, from a file's ``geo`` entry."""
    found = {}
    for name, c in json.loads(raw)["columns"].items():
        kinds = c.get("geometry_types", [])
        code = ((c.get("crs") or {}).get("id") or {}).get("code", 4326)
        found[name] = {geo.TYPE_KEY: kinds[0] if len(kinds) == 1 else "Geometry", geo.EPSG_KEY: int(code)}
    return found


def footer_geo(spark: SparkSession, path: str) -> dict[str, dict]:
    """The ``geo`` entry of one of the files below ``path``, read through Hadoop, so that any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(conf).listStatus(p)
    for status in files:
        if status.getPath().getName().endswith(".parquet"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            try:
                entry = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
            finally:
                reader.close()
            return parse_geo_metadata(entry) if entry else {}
    return {}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Columns and predicate reach the scan. Geometry columns get back the metadata of the file's ``geo`` entry."""
    df = spark.read.parquet(path)
    tags = footer_geo(spark, path)
    if any(n in tags and not geo.is_geometry(df, n) for n in df.columns):
        df = df.select(*(F.col(n).alias(n, metadata=tags[n]) if n in tags else F.col(n) for n in df.columns))
    df = df if predicate is None else df.filter(predicate)
    return df if columns is None else select_cols(df, *columns)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", block_bytes: int | None = None, bloom: list[str] | None = None, bloom_fpp: float = 0.01, mode: str = "errorifexists") -> None:
    """Geometry metadata is kept in the schema; ``write_geoparquet`` also writes the ``geo`` entry."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    w = df.write.mode(mode).option("compression", codec)
    if block_bytes:
        w = w.option("parquet.block.size", block_bytes)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", str(bloom_fpp))
    w.parquet(path)


def write_geoparquet(df: DataFrame, path: str) -> None:
    """One local GeoParquet file, for interchange: its rows go through the driver in batches."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pa.schema([(f.name, df.limit(0).toArrow().schema.field(f.name).type) for f in df.schema.fields], metadata={"geo": json.dumps(geo_metadata(df))})
    with pq.ParquetWriter(path, schema) as writer:
        rows = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            rows.append(row.asDict(recursive=True))
            if len(rows) == 65_536:
                writer.write_table(pa.Table.from_pylist(rows, schema))
                rows = []
        writer.write_table(pa.Table.from_pylist(rows, schema))


# CSV


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, delimiter: str = ",", comment: str | None = None, skip_rows: int = 0, null_tokens: list[str] | None = None, time_format: str | None = None, wkt: dict[str, int] | None = None) -> DataFrame:
    """Typed CSV, compressed or not by its suffix. ``wkt`` names the WKT columns, with their EPSG codes, to become WKB.

    With several null tokens, or rows to skip, fields are read as text first and cast; with rows to skip, a field has no line breaks.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wkt, tokens = wkt or {}, null_tokens if null_tokens is not None else [""]
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    kept = StructType([StructField(f.name, StringType() if f.name in wkt else f.dataType) for f in schema.fields])
    plain = len(tokens) == 1 and not skip_rows
    reader = spark.read.schema(kept if plain else text).option("header", header and not skip_rows).option("sep", delimiter).option("nullValue", tokens[0]).option("emptyValue", "")
    if comment:
        reader = reader.option("comment", comment)
    if time_format and plain:
        reader = reader.option("timestampFormat", time_format)
    if skip_rows:
        lines = after_first(spark, path, skip_rows + header).filter("col <> ''")
        df = lines.select(F.from_csv("col", ", ".join(f"`{f.name}` string" for f in schema.fields), {"sep": delimiter} | ({"comment": comment} if comment else {})).alias("r")).select("r.*")
    else:
        df = reader.csv(path)
    if not plain:
        value = lambda f: F.when(~F.col(f.name).isin(*tokens), F.col(f.name))
        cast = lambda f: value(f) if f.name in wkt else F.to_timestamp(value(f), time_format) if time_format and isinstance(f.dataType, TimestampType) else value(f).cast(f.dataType)
        df = df.select(*(cast(f).alias(f.name) for f in schema.fields))
    return df.select(*(geo.tag(geo.from_wkt(c), c, epsg=wkt[c]) if c in wkt else F.col(c) for c in df.columns))


def after_first(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """col string: the lines of each file but its first ones, which lie in its first split; files are split and read in parallel."""
    lines = spark.read.text(path).select(F.col("value").alias("col"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def kept(batches):
        seen: dict[str, int] = {}
        for t in batches:
            first = t[t["start"] == 0]
            number = first.groupby("file").cumcount() + first["file"].map(lambda f: seen.get(f, 0))
            for file, n in first["file"].value_counts().items():
                seen[file] = seen.get(file, 0) + int(n)
            yield t.drop(number.index[number < skip])[["col"]]

    return lines.mapInPandas(kept, "col string")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", delimiter).option("header", header).csv(path)


# dataclasses

KINDS = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType(), bytes: BinaryType(), datetime: TimestampType()}


def column_names(kind: type, form: str = "") -> dict[str, str]:
    """Column by field: metadata under the format's name, then ``larkspur``, then ``csv``, then the field; "-" leaves one out."""
    out = {}
    for f in dataclasses.fields(kind):
        name = next((f.metadata[k] for k in (form, "larkspur", "csv") if k in f.metadata), f.name)
        if name != "-":
            out[f.name] = name
    return out


def struct_schema(kind: type, form: str = "") -> StructType:
    names, hints = column_names(kind, form), typing.get_type_hints(kind)
    fields = []
    for field, name in names.items():
        inner = [a for a in typing.get_args(hints[field]) if a is not type(None)]
        optional = type(None) in typing.get_args(hints[field])
        fields.append(StructField(name, KINDS[inner[0] if optional else hints[field]], optional))
    return StructType(fields)


def from_structs(spark: SparkSession, rows: list, kind: type | None = None, form: str = "") -> DataFrame:
    kind = kind or type(rows[0])
    names = column_names(kind, form)
    return spark.createDataFrame([tuple(getattr(r, f) for f in names) for r in rows], struct_schema(kind, form))


def to_structs(df: DataFrame, kind: type, form: str = "") -> list:
    """Collects ``df``: for results that the driver can hold."""
    names = column_names(kind, form)
    return [kind(**{f: r[n] for f, n in names.items()}) for r in df.select(*names.values()).collect()]


# databases


def table_query(table: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, geometry: list[str] | None = None) -> str:
    """The query that ``read_table`` sends; geometry columns come as EWKB."""
    chosen = ", ".join(f"ST_AsEWKB({c}) AS {c}" if c in (geometry or []) else c for c in columns or ["*"])
    return f"SELECT {chosen} FROM {table}" + (f" WHERE {where}" if where else "") + (f" LIMIT {limit}" if limit else "")


def read_table(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, geometry: list[str] | None = None, properties: dict | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A PostGIS (or other JDBC) table; geometry columns come as EWKB and become WKB. ``columns`` must be named with ``geometry``.

    ``partition``: a numeric column, its least and greatest value, and the number of parallel reads.
    """
    if geometry and not columns:
        raise ValueError("columns must be named where some are geometry")
    options = dict(properties or {})
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    df = spark.read.format("jdbc").option("url", url).option("dbtable", f"({table_query(table, columns, where, limit, geometry)}) q").options(**options).load()
    return df.select(*(geo.tag(geo.from_ewkb(c), c) if c in (geometry or []) else F.col(c) for c in df.columns))


def write_table(df: DataFrame, url: str, table: str, truncate: bool = False, geometry: dict[str, int] | None = None, properties: dict | None = None) -> None:
    """Appends to a table that exists; geometry columns go as EWKB with the SRID given."""
    df = df.select(*(geo.to_ewkb(c, geometry[c]).alias(c) if c in (geometry or {}) else F.col(c) for c in df.columns))
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    (w.option("truncate", "true").mode("overwrite") if truncate else w.mode("append")).save()


def save_bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], sort: list[str] | None = None) -> None:
    """A table whose rows lie together by key: joins and groupings on the keys need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*(sort or keys)).mode("overwrite").saveAsTable(name)


# predicates for foreign engines

OPERATORS = {"=", "<>", "<", "<=", ">", ">="}
#: Spark's names of the comparisons.
COMPARISONS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def where_sql(conjuncts: list[tuple[str, str, object]]) -> tuple[str, list]:
    """(WHERE text with placeholders, arguments) of column-operator-value triples; equality with null is IS NULL."""
    parts, arguments = [], []
    for name, operator, value in conjuncts:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        if value is None:
            parts.append(f"{identifier(name)} IS {'NOT ' if operator == '<>' else ''}NULL")
        else:
            parts.append(f"{identifier(name)} {operator} ?")
            arguments.append(value)
    return " AND ".join(parts), arguments


def expression_sql(df: DataFrame, condition: Column) -> tuple[str, list]:
    """(WHERE text with placeholders, arguments) of a condition on ``df``'s columns: comparisons, AND, OR, NOT, IS NULL, IN and arithmetic.

    The condition is resolved against ``df`` first, so that types are checked; what has no such form raises ValueError.
    """
    plan = df.filter(condition)._jdf.queryExecution().analyzed()
    arguments: list = []

    def children(node) -> list:
        found = node.children()
        return [found.apply(i) for i in range(found.size())]

    def value(node):
        raw = node.value()
        if raw is None or isinstance(raw, (bool, int, float, str)):
            return raw
        text = node.toString()
        kind = node.dataType().typeName()
        if kind == "string" or kind.startswith("decimal"):
            return text
        raise ValueError(f"a value of type {kind} has no place in a condition")

    def text(node) -> str:
        kind = node.getClass().getSimpleName()
        below = children(node)
        if kind == "AttributeReference":
            return identifier(node.name())
        if kind == "Literal":
            arguments.append(value(node))
            return "?"
        if kind == "Cast":
            # what resolution put in to make both sides of one type
            return text(below[0])
        if kind in ("And", "Or"):
            return f"({text(below[0])} {kind.upper()} {text(below[1])})"
        if kind == "Not":
            return f"(NOT {text(below[0])})"
        if kind in ("IsNull", "IsNotNull"):
            return f"{text(below[0])} IS {'NOT ' if kind == 'IsNotNull' else ''}NULL"
        if kind == "In":
            return f"{text(below[0])} IN ({', '.join(map(text, below[1:]))})"
        if kind in COMPARISONS:
            return f"{text(below[0])} {COMPARISONS[kind]} {text(below[1])}"
        if kind in ("Add", "Subtract", "Multiply"):
            return f"({text(below[0])} {dict(Add='+', Subtract='-', Multiply='*')[kind]} {text(below[1])})"
        raise ValueError(f"{kind} has no form in SQL for other engines")

    return text(plan.condition()), arguments
