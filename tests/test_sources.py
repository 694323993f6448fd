"""Each format written and read back."""

from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.sources import connector, geofiles, tabular

PLACES = [("Alpha", 3, 1.5, True, "POINT (1 2)"), ("Bravo", None, 2.5, False, "POINT (-3 4.5)"), ("Charlie", 7, None, None, None)]
SHAPES = [("a", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), ("b", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))")]


@pytest.fixture(scope="module")
def places(spark):
    df = spark.createDataFrame(PLACES, "name string, n long, x double, ok boolean, wkt string")
    return df.select("name", "n", "x", "ok", geo.tag(geo.from_wkt("wkt"), "geometry", "Point"))


def shown(df, *names):
    return sorted(map(tuple, df.withColumn("geometry", geo.to_wkt("geometry")).select(*names).collect()), key=str)


ALL = ("name", "n", "x", "ok", "geometry")


def test_parquet_keeps_geometry_metadata(spark, places, tmp_path):
    tabular.write_parquet(places, str(tmp_path / "p"), "zstd", bloom=["name"])
    back = tabular.read_parquet(spark, str(tmp_path / "p"), ["name", "geometry"], F.col("n") > 2)
    assert back.count() == 2 and geo.is_geometry(back, "geometry") and geo.epsg_of(back, "geometry") == 4326
    tabular.write_geoparquet(places, str(tmp_path / "one.parquet"))
    again = tabular.read_parquet(spark, str(tmp_path / "one.parquet"))
    assert geo.is_geometry(again, "geometry") and shown(again, *ALL) == shown(places, *ALL)


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("note\nname;n;g\nAlpha;1;POINT (1 2)\nBravo;NA;\nCharlie;-;POINT (3 4)\n")
    df = tabular.read_csv(spark, str(path), "name string, n long, g string", delimiter=";", skip_rows=1, null_tokens=["", "NA", "-"], wkt={"g": 4326})
    assert [tuple(r) for r in df.select("name", "n", geo.to_wkt("g")).orderBy("name").collect()] == [("Alpha", 1, "POINT (1 2)"), ("Bravo", None, None), ("Charlie", None, "POINT (3 4)")]


def test_csv_skips_the_first_rows_of_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("note\nname,n\n" + "".join(f"r{i}_{k},{k}\n" for k in range(5)))
    df = tabular.read_csv(spark, str(tmp_path), "name string, n long", skip_rows=1)
    assert sorted(map(tuple, df.collect())) == sorted((f"r{i}_{k}", k) for i in range(3) for k in range(5))


def test_geojson(spark, places, tmp_path):
    geofiles.write_geojson(places, str(tmp_path / "p.geojson"))
    assert shown(geofiles.read_geojson(spark, str(tmp_path / "p.geojson")), *ALL) == shown(places, *ALL)
    geofiles.write_geojsonl(places, str(tmp_path / "p.geojsonl"))
    assert shown(geofiles.read_geojson(spark, str(tmp_path / "p.geojsonl")), *ALL) == shown(places, *ALL)


def test_geopackage(spark, places, tmp_path):
    path = str(tmp_path / "p.gpkg")
    geofiles.write_gpkg(places, path, "places")
    geofiles.write_gpkg(places.limit(1), path, "other")
    assert geofiles.gpkg_layers(path) == ["other", "places"]
    assert shown(geofiles.read_gpkg(spark, path, "places"), *ALL) == shown(places, *ALL)
    assert geofiles.read_gpkg(spark, path, "places", ["name"], [("n", ">", 2), ("x", "<>", None)]).collect() == [("Alpha",)]
    assert geofiles.gpkg_aggregate(path, "places", "sum", "n") == 10
    geofiles.write_gpkg(places.limit(2), path, "places", replace=True)
    assert geofiles.gpkg_aggregate(path, "places", "count") == 2


@pytest.mark.parametrize("suffix", ["kml", "kmz"])
def test_kml(spark, places, tmp_path, suffix):
    path = str(tmp_path / f"p.{suffix}")
    geofiles.write_kml(places, path)
    back = geofiles.read_kml(spark, path)
    assert shown(back, "name", "n", "geometry") == [("Alpha", "3", "POINT (1 2)"), ("Bravo", None, "POINT (-3 4.5)"), ("Charlie", "7", None)]


def test_shapefile(spark, places, tmp_path):
    geofiles.write_shapefile(places, str(tmp_path / "p.shp"))
    assert shown(geofiles.read_shapefile(spark, str(tmp_path / "p.shp")), *ALL) == shown(places, *ALL)
    shapes = spark.createDataFrame(SHAPES, "name string, wkt string").select("name", geo.tag(geo.from_wkt("wkt"), "geometry", epsg=32611))
    geofiles.write_shapefile(shapes, str(tmp_path / "s.shp"))
    back = geofiles.read_shapefile(spark, str(tmp_path / "s.shp"))
    assert shown(back, "name", "geometry") == shown(shapes, "name", "geometry") and geo.epsg_of(back, "geometry") == 32611


@dataclass
class Trade:
    symbol: str
    size: int
    price: float | None = field(default=None, metadata={"csv": "px"})
    note: str = field(default="", metadata={"larkspur": "-"})


def test_structs(spark):
    rows = [Trade("A", 1, 2.5), Trade("B", 2, None)]
    df = tabular.from_structs(spark, rows)
    assert df.columns == ["symbol", "size", "px"] and tabular.to_structs(df, Trade) == rows


def test_bucketed_tables_need_no_shuffle(spark):
    df = spark.range(100).selectExpr("id % 10 AS k", "id AS v")
    tabular.save_bucketed(df, "larkspur_bucketed", 4, ["k"])
    plan = spark.table("larkspur_bucketed").groupBy("k").sum("v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE larkspur_bucketed")


def test_where_sql():
    assert tabular.where_sql([("a", "=", 1), ("b", "=", None), ("c", "<>", None)]) == ('"a" = ? AND "b" IS NULL AND "c" IS NOT NULL', [1])


def test_expression_sql(spark):
    df = spark.range(10).selectExpr("id AS a", "CAST(id AS STRING) AS b", "id * 0.5D AS c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert tabular.expression_sql(df, (a > 3) & ((b == "x") | c.isNull())) == ('("a" > ? AND ("b" = ? OR "c" IS NULL))', [3, "x"])
    assert tabular.expression_sql(df, ~a.isin(1, 2) & (c * 2.0 <= 5.0)) == ('((NOT "a" IN (?, ?)) AND ("c" * ?) <= ?)', [1, 2, 2.0, 5.0])
    text, arguments = tabular.expression_sql(df, (a != 4) & c.isNotNull() & (b >= "2"))
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (a, b, c)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r) for r in df.collect()])
    assert db.execute(f"SELECT a FROM t WHERE {text}", arguments).fetchall() == [(r.a,) for r in df.filter((a != 4) & c.isNotNull() & (b >= "2")).collect()]
    with pytest.raises(ValueError):
        tabular.expression_sql(df, F.upper(b) == "X")


def test_table_query_and_ewkb(spark):
    assert tabular.table_query("s.places", ["id", "g"], "id > 5", 10, ["g"]) == "SELECT id, ST_AsEWKB(g) AS g FROM s.places WHERE id > 5 LIMIT 10"
    assert tabular.table_query("places") == "SELECT * FROM places"
    with pytest.raises(ValueError):
        tabular.read_table(spark, "jdbc:none", "places", geometry=["g"])
    raw = spark.createDataFrame([("POINT (1 2)",)], "w string").select(geo.to_ewkb(geo.from_wkt("w"), 3857).alias("e"))
    assert bytes(raw.first().e).hex() == "0101000020110f0000000000000000f03f0000000000000040"
    assert raw.select(geo.to_wkt(geo.from_ewkb("e"))).first()[0] == "POINT (1 2)"


def test_csv_by_suffix(spark, tmp_path):
    import gzip

    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"name;n\nAlpha;1\n"))
    assert [tuple(r) for r in tabular.read_csv(spark, str(tmp_path / "c.csv.gz"), "name string, n long", delimiter=";").collect()] == [("Alpha", 1)]


def test_shapefile_without_attributes(spark, places, tmp_path):
    geofiles.write_shapefile(places.filter("geometry IS NOT NULL"), str(tmp_path / "n.shp"))
    (tmp_path / "n.dbf").unlink()
    back = geofiles.read_shapefile(spark, str(tmp_path / "n.shp"))
    assert back.columns == ["geometry"] and shown(back, "geometry") == [("POINT (-3 4.5)",), ("POINT (1 2)",)]


def test_connector(spark):
    class Numbers(connector.Connector):
        """0 up to the option ``most``, in two parts; filters on n from below are applied here."""

        name = "numbers"

        def schema(self):
            return "n long, half double"

        def parts(self, filters):
            most = int(self.options["most"])
            return [(0, most // 2), (most // 2, most)]

        def accepts(self, name, operator, value):
            return (name, operator) in (("n", ">"), ("n", "<>"))

        def read(self, part, filters):
            import pyarrow as pa

            low = max([v for _, operator, v in filters if operator == ">"], default=-1)
            found = [n for n in range(*part) if n > low]
            yield pa.RecordBatch.from_pydict({"n": found, "half": [n / 2 for n in found]}, pa.schema([("n", pa.int64()), ("half", pa.float64())]))

    df = connector.read(spark, Numbers, most="10")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 10
    kept = df.filter((F.col("n") > 6) & (F.col("half") < 4.5))
    assert sorted(r.n for r in kept.collect()) == [7, 8]
    assert "n > 6" not in kept._jdf.queryExecution().executedPlan().toString().split("Filter", 1)[1].split("\n", 1)[0]  # handed down, not applied again


def test_custom_expression(spark):
    from larkspur.functions import expr

    assert [r.d for r in spark.range(3).select(expr.custom(lambda s: s * 2, "long", "id").alias("d")).collect()] == [0, 2, 4]
