"""Semantics that small tables show best: nulls, order, errors, streams; and the catalog against SQL."""

import math
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.errors import ColumnNotFound, SchemaMismatch
from larkspur.functions import expr as X
from larkspur.functions import geo
from larkspur.operators import frame, groupby, joins, windows
from larkspur.operators.groupby import Agg
from larkspur.plans import catalog
from larkspur.streaming.resample import resample_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_catalog(spark, database, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in catalog.oracle_sql():
        found = database.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()) == rows
    assert rows


def values(df):
    return [tuple(r) for r in df.collect()]


def test_missing_columns_are_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for call in (lambda: frame.drop(df, "x"), lambda: frame.rename(df, "x", "y"), lambda: frame.select_cols(df, "x"), lambda: frame.explode(df, "x")):
        with pytest.raises(ColumnNotFound):
            call()
    with pytest.raises(SchemaMismatch):
        frame.concat(df, spark.createDataFrame([(1, 2.0)], "a int, b double"))
    with pytest.raises(SchemaMismatch):
        joins.join(df, spark.createDataFrame([(1,)], "k long"), "a", "k")


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(X.ieee_div("a", "b")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [3.0, None, None]


def test_lists(spark):
    df = spark.createDataFrame([([1, None, 3],), ([],), (None,)], "v array<int>")
    got = df.select(X.list_len("v"), X.list_sum("v", "long"), X.list_mean("v"), X.list_contains("v", 3), X.list_get("v", -1), X.list_slice("v", -2, 3), X.list_union("v", F.array(F.lit(1), F.lit(9))))
    assert values(got) == [(3, 4, 2.0, True, 3, [None, 3], [1, 3, 9]), (0, None, None, False, None, [], [1, 9]), (None, None, None, None, None, None, None)]


def test_explode_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, v array<int>")
    assert sorted(values(frame.explode(df, "v")), key=str) == [(1, 1), (1, 2), (2, None), (3, None)]
    g = spark.createDataFrame([(1, "MULTIPOINT ((1 2), (3 4))"), (2, "POINT (5 6)"), (3, None)], "id int, w string").select("id", geo.tag(geo.from_wkt("w"), "g"))
    assert sorted(values(geo.explode(g, "g").select("id", geo.to_wkt("g"))), key=str) == [(1, "POINT (1 2)"), (1, "POINT (3 4)"), (2, "POINT (5 6)"), (3, None)]


def test_joins_never_match_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k long, v string")
    count = {how: joins.join(left, right, "k", "k", how).count() for how in ("inner", "left", "right", "full", "semi", "anti")}
    assert count == {"inner": 1, "left": 3, "right": 3, "full": 5, "semi": 1, "anti": 2}
    full = joins.join(left, right, "k", "k", "full")
    assert full.columns == ["k", "v", "v_right"] and (3, None, "z") in values(full)


def test_null_keys_group_and_aggregates_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), (None, 5.0, 3), (None, 5.0, 4), ("b", None, 5)], "k string, v double, i int")
    got = groupby.aggregate(df, ["k"], Agg("v", "count"), Agg("v", "sum"), Agg("v", "last", order="i"), Agg("v", "mode", order="i"), Agg("v", "std"))
    assert sorted(values(got), key=str) == [("a", 1, 1.0, 1.0, 1.0, None), ("b", 0, None, None, None, None), (None, 2, 10.0, 5.0, 5.0, 0.0)]


def test_sort_puts_nan_above_and_null_last(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),), (0.5,)], "v double")
    up = [r[0] for r in frame.sort_by(df, "v").collect()]
    assert up[:2] == [0.5, 1.5] and math.isnan(up[2]) and up[3] is None
    down = [r[0] for r in frame.sort_by(df, ("v", True)).collect()]
    assert math.isnan(down[0]) and down[1:] == [1.5, 0.5, None]


def test_sets_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (2, "w")], "k int, v string")
    b = spark.createDataFrame([(None, "q"), (2, "q")], "k int, v string")
    assert {r.k for r in frame.intersect(a, b, "k").collect()} == {None, 2}
    assert values(frame.difference(a, b, "k")) == [(1, "x")]
    assert frame.unique(a, "k", order="v").filter("k IS NULL").collect()[0].v == "y"


def test_time_rolling_is_closed(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(seconds=i), float(i + 1)) for i in range(6)], "t timestamp, a double")
    got = windows.rolling_by(df, "t", 3_000_000, [], s=("a", "sum")).orderBy("t")
    assert [r.s for r in got.collect()] == [1, 3, 6, 10, 14, 18]


def test_spatial_join_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    shapes = [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(zip(rng.uniform(0, 50, 60), rng.uniform(0, 50, 60), rng.uniform(0.01, 30, 60) ** 1.5, rng.uniform(0.01, 9, 60)))]
    text = lambda s: f"POLYGON (({s[1]} {s[2]}, {s[3]} {s[2]}, {s[3]} {s[4]}, {s[1]} {s[4]}, {s[1]} {s[2]}))"
    make = lambda rows: spark.createDataFrame([(s[0], text(s)) for s in rows], "id long, w string").select("id", geo.from_wkt("w").alias("g"))
    got = sorted(values(joins.sjoin(make(shapes), make(shapes[::2]), "g", "g").select("id", "id_right")))
    want = sorted((a[0], b[0]) for a in shapes for b in shapes[::2] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want


def test_streaming_resample_equals_batch(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = resample_stream(stream, "ts", "1 day", "1 hour", Agg("", "count"), Agg("value", "max")).writeStream.outputMode("complete").format("memory").queryName("resampled").start()
    run.processAllAvailable()
    run.stop()
    batch = windows.resample(df, "ts", 86_400_000_000, Agg("", "count"), Agg("value", "max"))
    assert sorted(values(spark.table("resampled"))) == sorted(values(batch))


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["filter_expr"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_whole_joins_read_every_customer(spark, how):
    customers, nations = spark.range(1000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'c' AS c_name"), spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey", "'n' AS n_name", "0 AS n_regionkey")
    tables = {"customer": customers, "nation": nations}
    found = joins.join(*catalog.sides(tables.__getitem__), "c_nationkey", "n_nationkey", how)
    assert found.count() == {"inner": 800, "left": 1000, "right": 805, "full": 1005, "semi": 800, "anti": 200}[how]
    assert f"join_{how}" in catalog.queries()


def test_explode_list_gives_every_element(spark):
    elements = spark.read.parquet(f"{SF}/embeddings.parquet").agg(F.sum(F.size("embedding"))).first()[0]
    assert catalog.queries()["explode_list"](spark, SF).count() == elements


@pytest.mark.parametrize("kind", ["sum", "mean", "count", "min", "max"])
def test_time_rolling_against_plain_intervals(spark, kind):
    import numpy as np

    rng = np.random.default_rng(9)
    start, odd = datetime(2024, 1, 1), {3: None, 7: math.nan, 40: math.inf, 44: -math.inf}
    rows = [(i, None if i % 17 == 5 else f"k{min(2, int(rng.integers(0, 9)))}", start + timedelta(seconds=int(rng.integers(0, 60))), odd.get(i, float(rng.integers(0, 100)))) for i in range(300)] + [(300, "k0", None, 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp, a double")
    got = {r.id: r.v for r in windows.rolling_by(df, "t", 5_000_000, ["k"], v=("a", kind)).collect()}

    def plain(row):
        near = [r[3] for r in rows if row[2] is not None and r[2] is not None and r[1] == row[1] and timedelta(0) <= row[2] - r[2] <= timedelta(seconds=5) and r[3] is not None]
        if kind == "count" and row[2] is not None:
            return len(near)
        if not near:
            return None
        if kind in ("min", "max"):  # not a number is above all others
            return (min if kind == "min" else max)(near, key=lambda v: (math.isnan(v), v))
        return sum(near) / (len(near) if kind == "mean" else 1)

    for row in rows:
        want = plain(row)
        assert got[row[0]] == want or want is not None and (math.isnan(want) and math.isnan(got[row[0]]) or math.isclose(got[row[0]], want)), (row, want, got[row[0]])


def test_a_hot_key_rolls_in_many_tasks(spark):
    df = spark.range(1000).selectExpr("timestamp_seconds(id) AS t", "1.0D AS a", "id % 1 AS k")
    plan = windows.rolling_by(df, "t", 1_000_000, ["k"], s=("a", "sum"))._jdf.queryExecution().executedPlan().toString()
    (dealt,) = set(re.findall(r"hashpartitioning\((.*?), \d+\)", plan))
    assert dealt.startswith("_k0") and len(dealt.split(", ")) == 2  # the key and a bucket of time


def test_modes_over_pivots_and_intervals(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (1, "b", "y", 3), (2, "c", "y", 4)], "k int, v string, h string, o int")
    assert {(r.o, r.m) for r in windows.over(df, ["k"], Agg("v", "mode", "m")).collect()} == {(1, "b"), (2, "b"), (3, "b"), (4, "c")}
    assert {r.v_mode for r in windows.broadcast_agg(df, Agg("v", "mode")).collect()} == {"b"}
    assert sorted(values(groupby.pivot(df, "k", "h", "v", "mode", order="o"))) == [(1, "a", "b"), (2, None, "c")]
    assert sorted(values(groupby.pivot(df, "k", "h", "v", "last", order="o"))) == [(1, "b", "b"), (2, None, "c")]
    with pytest.raises(ValueError):
        groupby.pivot(df, "k", "h", "v", "first")


def test_spatial_join_of_points_and_a_large_polygon_fills_few_cells(spark):
    points = spark.range(200).select("id", geo.points_from_xy(F.col("id") * 1.0, F.col("id") * 1.0).alias("p"))
    text = "POLYGON ((10 10, 110 10, 110 60, 10 60, 10 10))"
    area = spark.createDataFrame([(1, text), (2, "POLYGON ((0 0, 0.5 0, 0.5 0.5, 0 0.5, 0 0))")], "a long, w string").select("a", geo.from_wkt("w").alias("g"))
    for df, g, others in ((area, "g", points), (points, "p", area)):
        other = joins.boxed(others, "p" if g == "g" else "g")
        levels = other.agg(F.collect_set("_own")).first()[0]
        assert joins.cells(joins.boxed(df, g), sorted(levels)).count() <= 4 * len(levels) * df.count()
    inside = {(1, i) for i in range(10, 61)} | {(2, 0)}
    assert set(values(joins.sjoin(area, points, "g", "p", "contains").select("a", "id"))) | {(1, 10), (1, 60), (2, 0)} == inside
    assert set(values(joins.sjoin(points, area, "p", "g").select("a", "id"))) == inside


def test_spatial_join_asks_once_of_a_pair_of_geometries(spark, monkeypatch):
    from larkspur.geometry.model import point, polygon, write_wkb

    shapes = [write_wkb(g) for g in (polygon([(0, 0), (2, 0), (2, 2), (0, 2)]), polygon([(1, 1), (9, 1), (9, 9), (1, 9)]), polygon([(20, 0), (21, 0), (21, 1), (20, 1)]))]
    dots = [write_wkb(g) for g in (point(0.5, 0.5), point(1.5, 1.5), point(30, 30))]
    left = spark.createDataFrame([(i, shapes[i % 3]) for i in range(600)] + [(600, None)], "a long, g binary")
    right = spark.createDataFrame([(i, dots[i % 3]) for i in range(300)] + [(300, None)], "a long, p binary")
    hits = {(0, 0), (0, 1), (1, 1)}
    want = sorted((i, j) for i in range(600) for j in range(300) if (i % 3, j % 3) in hits)
    asked, real = spark.sparkContext.accumulator(0), joins.geo.relate

    def counted(predicate):
        @F.udf("boolean")
        def ask(_, __):
            asked.add(1)
            return True

        return lambda a, b: real(predicate)(a, b) & ask(a, b)

    with monkeypatch.context() as m:
        m.setattr(joins.geo, "relate", counted)
        assert joins.sjoin(left, right, "g", "p", "contains").count() == len(want) and 3 <= asked.value <= 9
    for share in (joins.SHARE_ROWS, 70):  # the latter deals each geometry's rows to several tasks
        monkeypatch.setattr(joins, "SHARE_ROWS", share)
        assert sorted(values(joins.sjoin(left, right, "g", "p", "contains").select("a", "a_right"))) == want
    assert sorted(values(joins.sjoin(left.select("g"), right, "g", "p", "contains").groupBy("a").count())) == [(j, 200 * sum(h[1] == j % 3 for h in hits)) for j in range(300) if j % 3 < 2]


def test_division_query_equals_its_sql_on_odd_values(spark, tmp_path):
    values_ = [0.0, -1.0, None, math.nan, math.inf, 5.0, 1.41]
    rows = [(10 * i + k, 1, q, d) for i, q in enumerate(values_) for k, d in enumerate([0.0, -0.0, None, math.nan, 0.32, -0.07])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(values(catalog.queries()["ieee_division"](spark, str(tmp_path))), key=lambda r: r[:2])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    text = lambda found: [(a, b, str(r if r is None else r + 0.0)) for a, b, r in found]  # noqa: E731  zeros of either sign are equal
    assert text(got) == text(sorted(db.execute(catalog.oracle_sql()["ieee_division"]).fetchall(), key=lambda r: r[:2]))


def test_spatial_join_of_points_within_polygons_asks_once(spark, monkeypatch):
    points = spark.range(1500).select("id", geo.points_from_xy(F.lit(1.0), F.lit(1.0) + F.col("id") % 2).alias("p"))
    areas = spark.range(700).select(F.col("id").alias("a"), geo.from_wkt(F.lit("POLYGON ((0 0, 3 0, 3 1.5, 0 1.5, 0 0))")).alias("g"))
    asked, real = spark.sparkContext.accumulator(0), joins.geo.relate

    @F.udf("boolean")
    def ask(_, __):
        asked.add(1)
        return True

    monkeypatch.setattr(joins.geo, "relate", lambda predicate: lambda a, b: real(predicate)(a, b) & ask(a, b))
    got = joins.sjoin(points, areas, "p", "g", "within").agg(F.count("*"), F.count_distinct("id", "a"), F.max(F.col("id") % 2)).first()
    assert tuple(got) == (525_000, 525_000, 0) and asked.value <= 2
