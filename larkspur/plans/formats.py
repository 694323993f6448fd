"""Queries of the sources: each writes a table to the shared folder in a format and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.plans.catalog import boxes, register
from larkspur.session import shared_folder
from larkspur.sources import geofiles, tabular


def format_query(sql: str):
    """Registers a function of (spark, table reader, new path in the shared folder)."""

    def add(f: Callable[[SparkSession, Callable[[str], DataFrame], str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), shared_folder(spark, f.__name__))

        register(f.__name__, run, sql)
        return f

    return add


def local(path: str) -> str:
    """For formats of one file, which are written through a mounted path."""
    return path.removeprefix("file://")


@format_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")
def source_parquet(spark, t, path):
    tabular.write_parquet(t("part"), path, "zstd", bloom=["p_partkey"])
    return tabular.read_parquet(spark, path, ["p_partkey", "p_name", "p_size"], F.col("p_size") > 25)


@format_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_csv(spark, t, path):
    tabular.write_csv(t("customer").select("c_custkey", "c_name", "c_acctbal"), path, delimiter=";")
    return tabular.read_csv(spark, path, t("customer").select("c_custkey", "c_name", "c_acctbal").schema, delimiter=";")


@format_query("SELECT c_custkey, c_name, (c_custkey % 90)::DOUBLE AS x, (c_custkey % 45)::DOUBLE AS y FROM customer")
def source_geojson(spark, t, path):
    k = F.col("c_custkey")
    places = t("customer").select("c_custkey", "c_name", geo.tag(geo.points_from_xy(k % 90, k % 45), "geometry", "Point"))
    geofiles.write_geojsonl(places, path + ".geojsonl")
    back = geofiles.read_geojson(spark, path + ".geojsonl").withColumn("b", geo.bounds("geometry"))
    return back.select("c_custkey", "c_name", F.col("b.min_x").alias("x"), F.col("b.min_y").alias("y"))


SUPPLIERS = "SELECT s_suppkey, s_name, round((s_suppkey % 4 + 1) ** 2, 6)::DOUBLE AS area FROM supplier"


def squares(t) -> DataFrame:
    return boxes(t).join(t("supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", geo.tag("g", "geometry", "Polygon", 4326))


def measured(df: DataFrame) -> DataFrame:
    return df.select("s_suppkey", "s_name", F.round(geo.area("geometry", 3857), 6).alias("area"))


@format_query(SUPPLIERS)
def source_geopackage(spark, t, path):
    geofiles.write_gpkg(squares(t), local(path) + ".gpkg", "suppliers")
    return measured(geofiles.read_gpkg(spark, local(path) + ".gpkg", "suppliers"))


@format_query(SUPPLIERS)
def source_shapefile(spark, t, path):
    geofiles.write_shapefile(squares(t), local(path) + ".shp")
    return measured(geofiles.read_shapefile(spark, local(path) + ".shp"))


@format_query(SUPPLIERS)
def source_kml(spark, t, path):
    geofiles.write_kml(squares(t).withColumnRenamed("s_name", "name"), local(path) + ".kmz")
    back = geofiles.read_kml(spark, local(path) + ".kmz")
    return measured(back.withColumnRenamed("name", "s_name").withColumn("s_suppkey", F.col("s_suppkey").cast("long")))


@format_query(SUPPLIERS)
def source_geoparquet(spark, t, path):
    tabular.write_geoparquet(squares(t), local(path) + ".parquet")
    return measured(tabular.read_parquet(spark, path + ".parquet"))
