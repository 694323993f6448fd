"""One query per operator over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.functions import geo
from larkspur.geometry import transform
from larkspur.operators import frame, groupby, joins, windows
from larkspur.operators.groupby import Agg

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: The tables' timestamps have no zone.
NAIVE = "timestamp_ntz"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name."""

    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _queries[name], _sql[name] = run, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# projection, filter, row selection


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def filter_expr(t):
    return t("orders").filter((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def project_with_column(t):
    df = t("lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT c_name AS customer, c_custkey FROM customer")
def select_drop_rename(t):
    df = frame.drop(t("customer"), "c_acctbal", "c_mktsegment", "c_nationkey")
    return frame.select_cols(frame.rename(df, "c_name", "customer"), "customer", "c_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def head_rows(t):
    return frame.head(t("orders").select("o_orderkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def tail_rows(t):
    return frame.tail(t("orders").select("o_orderkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey")


@query("SELECT event_id, value FROM events WHERE event_id IN (3, 5, 8) UNION ALL SELECT event_id, value FROM events WHERE event_id = 5")
def take_rows(t):
    return frame.take(t("events").select("event_id", "value"), "event_id", [8, 5, 3, 5])


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def explode_list(t):
    return frame.explode(t("embeddings").select("vec_id", F.col("embedding").alias("x")), "x")


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 40")
def sort_top_k(t):
    return frame.head(t("part").select("p_brand", "p_size", "p_partkey"), 40, ("p_size", True), "p_brand", "p_partkey")


# expressions


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE round(l_quantity / l_discount, 4) END AS ratio FROM lineitem")
def ieee_division(t):
    # the SQL has one infinity for whatever is divided by zero
    ratio = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.round(X.ieee_div("l_quantity", "l_discount"), 4))
    return t("lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))


@query("SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE (v > 50 OR user_id % 2 = 0) END AS flag, CASE WHEN v IS NULL THEN NULL WHEN v > 50 THEN 'high' ELSE 'low' END AS label, coalesce(v, -1) AS filled FROM (SELECT event_id, user_id, CASE WHEN user_id % 3 <> 0 THEN value END AS v FROM events)")
def strict_logic_and_nulls(t):
    v = F.when(F.col("user_id") % 3 != 0, F.col("value"))
    return t("events").select("event_id", X.either(v > 50, F.col("user_id") % 2 == 0).alias("flag"), X.if_(v > 50, F.lit("high"), F.lit("low")).alias("label"), F.coalesce(v, F.lit(-1.0)).alias("filled"))


@query("SELECT o_orderkey, o_orderkey & 255 AS low, o_custkey | 1 AS odd, xor(o_orderkey, o_custkey) AS mixed, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def bitwise_and_casts(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select("o_orderkey", X.bit_and(a, F.lit(255)).alias("low"), X.bit_or(b, F.lit(1)).alias("odd"), X.bit_xor(a, b).alias("mixed"), X.as_number("o_totalprice", "long").alias("whole"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n, embedding[1] AS first, embedding[-1] AS last, embedding[100] AS beyond, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(list_avg(embedding::DOUBLE[]), 6) AS mean, list_min(embedding) AS low, list_max(embedding) AS high, embedding[1:3] AS head FROM embeddings")
def list_functions(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", X.list_len(e).alias("n"), X.list_get(e, 0).alias("first"), X.list_get(e, -1).alias("last"), X.list_get(e, 99).alias("beyond"), F.round(X.list_sum(e), 6).alias("total"), F.round(X.list_mean(e), 6).alias("mean"), X.list_min(e).alias("low"), X.list_max(e).alias("high"), X.list_slice(e, 0, 3).alias("head"))


@query("SELECT p_partkey, len(list_distinct([p_size, p_size % 7, p_size % 5]))::BIGINT AS n, (p_size % 7 = 3 OR p_size = 3) AS has FROM part")
def list_sets(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", X.list_len(X.list_union(F.array(s, s % 7), F.array(s % 5, F.lit(None).cast("int")))).alias("n"), X.list_contains(F.array(s, s % 7), 3).alias("has"))


HAVERSINE = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"


@query(f"SELECT c_custkey, round({HAVERSINE}, 6) AS km FROM (SELECT c_custkey, power(sin(radians((c_custkey % 160 - 80) - 10) / 2), 2) + cos(radians(10)) * cos(radians(c_custkey % 160 - 80)) * power(sin(radians(c_custkey % 350 - 175 - 20) / 2), 2) AS h FROM customer)")
def haversine_distance(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", F.round(X.haversine(F.lit(10), F.lit(20), k % 160 - 80, k % 350 - 175), 6).alias("km"))


@query("SELECT event_id, year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, day(ts)::BIGINT AS d, hour(ts)::BIGINT AS h, dayofweek(ts)::BIGINT AS weekday, dayofyear(ts)::BIGINT AS day_of_year, epoch_us(ts) * 1000 AS ns, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('hour', ts) AS hour_start, ts + INTERVAL 90 SECOND AS later FROM events")
def time_components(t):
    names = {"y": "year", "m": "month", "d": "day", "h": "hour", "weekday": "weekday", "day_of_year": "day_of_year"}
    return t("events").select("event_id", *(X.component("ts", p).alias(n) for n, p in names.items()), X.unix_nano("ts").alias("ns"), X.truncate_calendar("ts", "week").cast(NAIVE).alias("week"), X.truncate("ts", HOUR).cast(NAIVE).alias("hour_start"), X.add_micros("ts", 90_000_000).cast(NAIVE).alias("later"))


# aggregation


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_pricing_summary(t):
    df = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS count, count(value) AS value_count, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max, round(stddev_samp(value), 6) AS value_std, round(var_samp(value), 4) AS value_var, count(DISTINCT user_id) AS user_id_nunique, round(median(value), 6) AS value_median FROM events GROUP BY event_type")
def agg_kinds(t):
    kinds = ["count", "sum", "mean", "min", "max", "std", "var"]
    out = groupby.aggregate(t("events"), ["event_type"], Agg("", "count"), *(Agg("value", k) for k in kinds), Agg("user_id", "nunique"), Agg("value", "median"))
    digits = {"value_sum": 4, "value_mean": 6, "value_std": 6, "value_var": 4, "value_median": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type_first, arg_max(event_type, event_id) AS event_type_last FROM events GROUP BY user_id")
def agg_first_last(t):
    return groupby.aggregate(t("events"), ["user_id"], Agg("event_type", "first", order="event_id"), Agg("event_type", "last", order="event_id"))


@query("SELECT user_id, arg_min(event_type, -n * 1000000000 + first_id) AS event_type_mode FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL) GROUP BY user_id")
def agg_mode(t):
    return groupby.aggregate(t("events"), ["user_id"], Agg("event_type", "mode", order="event_id"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM orders GROUP BY o_orderpriority")
def agg_filtered(t):
    out = groupby.aggregate(t("orders"), ["o_orderpriority"], Agg("", "count", "finished", where=F.col("o_orderstatus") == "F"), Agg("o_totalprice", "sum", "large", where=F.col("o_totalprice") > 100000))
    return out.withColumn("large", F.round("large", 2))


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS c_mktsegment_collect_set FROM customer GROUP BY c_nationkey")
def agg_collect_set(t):
    return groupby.aggregate(t("customer"), ["c_nationkey"], Agg("c_mktsegment", "collect_set"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS \"F\", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS \"O\" FROM lineitem GROUP BY l_returnflag")
def agg_pivot(t):
    out = groupby.pivot(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return out.withColumns({c: F.round(c, 2) for c in out.columns[1:]})


@query("SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END) AS \"BUILDING\", max(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END) AS \"MACHINERY\" FROM (SELECT c_nationkey, c_mktsegment, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def agg_pivot_last(t):
    return groupby.pivot(t("customer"), "c_nationkey", "c_mktsegment", "c_name", "last", ["BUILDING", "MACHINERY"], order="c_custkey")


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY ALL")
def value_counts(t):
    return frame.value_counts(t("customer"), "c_mktsegment")


class Range(groupby.Aggregator):
    """Highest less lowest value."""

    partial_schema, result_schema = "low double, high double", "spread double"

    def update(self, rows):
        return {"low": rows["value"].min(), "high": rows["value"].max()}

    def merge(self, partials):
        return {"low": partials["low"].min(), "high": partials["high"].max()}

    def finish(self, partial):
        return {"spread": partial["high"] - partial["low"]}


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def agg_custom(t):
    return groupby.custom(t("events").select("event_type", "value"), ["event_type"], Range())


# joins

# the whole tables; keys that are shifted match nothing, on both sides
RIGHT = "(SELECT CASE WHEN n_nationkey >= 20 THEN n_nationkey + 1000 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation)"
LEFT = "(SELECT c_custkey, c_nationkey, c_name AS n_name FROM customer)"


def sides(t):
    left = t("customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("n_name"))
    key = F.when(F.col("n_nationkey") >= 20, F.col("n_nationkey") + 1000).otherwise(F.col("n_nationkey")).alias("n_nationkey")
    return left, t("nation").select(key, "n_name", "n_regionkey")


def register_join(how: str, sql: str) -> None:
    def run(t):
        return joins.join(*sides(t), "c_nationkey", "n_nationkey", how)

    run.__name__ = f"join_{how}"
    query(sql)(run)


for _how, _clause in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    register_join(_how, f"SELECT c_custkey, {'coalesce(c_nationkey, n_nationkey) AS c_nationkey' if _how in ('right', 'full') else 'c_nationkey'}, l.n_name, r.n_name AS n_name_right, n_regionkey FROM {LEFT} l {_clause} {RIGHT} r ON c_nationkey = n_nationkey")
for _how, _clause in (("semi", "SEMI JOIN"), ("anti", "ANTI JOIN")):
    register_join(_how, f"SELECT c_custkey, c_nationkey, l.n_name FROM {LEFT} l {_clause} {RIGHT} r ON c_nationkey = n_nationkey")

@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_star(t):
    nation = joins.bounded(t("nation").select("n_nationkey", "n_name"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # revenue per order is summed before it meets customers
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("net").alias("net"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("net"), 2).alias("revenue"))


# windows


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type), 3) AS value_sum, count(*) OVER (PARTITION BY event_type) AS count FROM events")
def over_partition(t):
    out = windows.over(t("events").select("event_id", "event_type", "value"), ["event_type"], Agg("value", "sum"), Agg("", "count"))
    return out.select("event_id", F.round("value_sum", 3).alias("value_sum"), "count")


@query("SELECT event_id, arg_min(event_type, -n * 1000000000 + first_id) OVER (PARTITION BY user_id) AS event_type_mode FROM events JOIN (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL) USING (user_id, event_type)")
def over_mode(t):
    out = windows.over(t("events").select("event_id", "user_id", "event_type"), ["user_id"], Agg("event_type", "mode", order="event_id"))
    return out.select("event_id", "event_type_mode")


@query("SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (), 4) AS off FROM supplier")
def over_whole_table(t):
    out = windows.broadcast_agg(t("supplier").select("s_suppkey", "s_acctbal"), Agg("s_acctbal", "mean"))
    return out.select("s_suppkey", F.round(F.col("s_acctbal") - F.col("s_acctbal_mean"), 4).alias("off"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def shift_and_diff(t):
    keys, order = ["user_id"], ["ts", "event_id"]
    return t("events").select("event_id", windows.shift("value", 1, keys, order).alias("before"), windows.shift("value", -1, keys, order).alias("after"), F.round(windows.diff("value", 1, keys, order), 6).alias("change"))


@query("SELECT event_id, CASE WHEN row_number() OVER w >= 4 THEN round(sum(value) OVER r, 4) END AS total, CASE WHEN row_number() OVER w >= 4 THEN max(value) OVER r END AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_rows(t):
    keys, order = ["user_id"], ["ts", "event_id"]
    return t("events").select("event_id", F.round(windows.rolling("value", 4, "sum", keys, order), 4).alias("total"), windows.rolling("value", 4, "max", keys, order).alias("high"))


@query("SELECT event_id, round(sum(value) OVER r, 4) / count(value) OVER r AS mean, count(value) OVER r AS n FROM events WINDOW r AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
def rolling_time(t):
    out = windows.rolling_by(t("events").select("event_id", "event_type", "ts", "value"), "ts", DAY, ["event_type"], total=("value", "sum"), n=("value", "count"))
    # means of 32 or 64 values of two decimals lie on ties of rounding, so the sum is rounded
    return out.select("event_id", (F.round("total", 4) / F.col("n")).alias("mean"), "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS count, round(sum(value), 4) AS value_sum, max(value) AS value_max FROM events GROUP BY 1")
def resample_every(t):
    out = windows.resample(t("events"), "ts", 6 * HOUR, Agg("", "count"), Agg("value", "sum"), Agg("value", "max"))
    return out.withColumn("value_sum", F.round("value_sum", 4)).withColumn("ts", F.col("ts").cast(NAIVE))


# distinct and sets


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, event_id")
def unique_first(t):
    return frame.unique(t("events").select("user_id", "event_id", "event_type"), "user_id", order="event_id")


@query("SELECT count(DISTINCT l_partkey) AS l_partkey_nunique FROM lineitem")
def n_unique(t):
    return frame.n_unique(t("lineitem"), "l_partkey")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_concat(t):
    return frame.concat(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return frame.union(t("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def set_intersect(t):
    return frame.intersect(t("lineitem").filter("l_quantity > 45").select("l_partkey"), t("lineitem").filter("l_discount > 0.05").select("l_partkey"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def set_difference_by_key(t):
    left = t("customer").select("c_nationkey", "c_mktsegment").distinct()
    keys = t("supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    # keyed, and all rows of a key that is left stay
    return left.join(keys, "c_nationkey", "left_anti")


# geometry; coordinates are made from keys, as the tables have none


def grid(t, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return t(name).select(key, ((k * 37) % 1000 / 10.0).alias("x"), ((k * 91) % 1000 / 10.0).alias("y"))


@query("SELECT c_custkey, 'Point' AS kind, (c_custkey * 37) % 1000 / 10.0 AS min_x, (c_custkey * 91) % 1000 / 10.0 AS max_y FROM customer")
def geo_points(t):
    p = grid(t, "customer", "c_custkey").withColumn("g", geo.points_from_xy("x", "y"))
    return p.withColumn("b", geo.bounds("g")).select("c_custkey", geo.kind("g").alias("kind"), "b.min_x", "b.max_y")


BOX = "concat('POLYGON ((', x, ' ', y, ', ', x + w, ' ', y, ', ', x + w, ' ', y + w, ', ', x, ' ', y + w, ', ', x, ' ', y, '))')"


def boxes(t) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    df = t("supplier").select("s_suppkey", (k * 7 % 95).alias("x"), (k * 13 % 95).alias("y"), (k % 4 + 1).alias("w"))
    return df.withColumn("g", geo.from_wkt(F.expr(BOX)))


@query("SELECT s_suppkey, round((s_suppkey % 4 + 1) ** 2, 6)::DOUBLE AS area, (4 * (s_suppkey % 4 + 1))::DOUBLE AS perimeter, round((s_suppkey * 7 % 95) + (s_suppkey % 4 + 1) / 2.0, 6)::DOUBLE AS cx FROM supplier")
def geo_measures(t):
    b = boxes(t).withColumn("c", geo.bounds(geo.centroid("g", 3857)))
    return b.select("s_suppkey", F.round(geo.area("g", 3857), 6).alias("area"), geo.length("g", 3857).alias("perimeter"), F.round("c.min_x", 6).alias("cx"))


@query("SELECT s_suppkey, round(w * w / 4.0, 6)::DOUBLE AS common, round(w * w * 1.75, 6)::DOUBLE AS both_, round(w * w * 0.75, 6)::DOUBLE AS rest, round(w * w * 1.5, 6)::DOUBLE AS either FROM (SELECT s_suppkey, s_suppkey % 4 + 1 AS w FROM supplier)")
def geo_boolean(t):
    moved = boxes(t).withColumn("h", geo.from_wkt(F.expr(BOX.replace("x", "(x + w / 2.0)").replace("y", "(y + w / 2.0)").replace("', (", "', ("))))
    names = {"common": "intersection", "both_": "union", "rest": "difference", "either": "symmetric_difference"}
    return moved.select("s_suppkey", *(F.round(geo.area(geo.boolean_op("g", "h", what, 3857), 3857), 6).alias(n) for n, what in names.items()))


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, (c_custkey * 37) % 1000 / 10.0 + 0.05 AS x, (c_custkey * 91) % 1000 / 10.0 + 0.05 AS y FROM customer) JOIN (SELECT s_suppkey, s_suppkey * 7 % 95 AS a, s_suppkey * 13 % 95 AS b, s_suppkey % 4 + 1 AS w FROM supplier) ON x > a AND x < a + w AND y > b AND y < b + w")
def geo_spatial_join(t):
    p = grid(t, "customer", "c_custkey").select("c_custkey", geo.points_from_xy(F.col("x") + 0.05, F.col("y") + 0.05).alias("p"))
    return joins.sjoin(p, boxes(t).select("s_suppkey", "g"), "p", "g", "within").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, round(radians(x) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137, 3) AS my FROM (SELECT c_custkey, (c_custkey * 37) % 1000 / 10.0 AS x, (c_custkey * 91) % 800 / 10.0 AS y FROM customer)")
def geo_reproject(t):
    k = F.col("c_custkey")
    df = t("customer").select("c_custkey", geo.points_from_xy((k * 37) % 1000 / 10.0, (k * 91) % 800 / 10.0).alias("g"))
    return df.withColumn("b", geo.bounds(geo.to_crs("g", 4326, 3857))).select("c_custkey", F.round("b.min_x", 3).alias("mx"), F.round("b.min_y", 3).alias("my"))


@query("SELECT c_custkey, sqrt(power((c_custkey * 37) % 1000 / 10.0 - 50, 2) + power((c_custkey * 91) % 1000 / 10.0 - 50, 2)) <= 30 AS near, round(sqrt(power((c_custkey * 37) % 1000 / 10.0 - 50, 2) + power((c_custkey * 91) % 1000 / 10.0 - 50, 2)) - 30, 6) AS gap, power(((c_custkey * 37) % 1000 / 10.0 - 50) / 40, 2) + power(((c_custkey * 91) % 1000 / 10.0 - 50) / 20, 2) <= 1 AS in_ellipse FROM customer")
def geo_circles(t):
    circle, ellipse = transform.Circle(50, 50, 30, 3857), transform.Ellipse(50, 50, 40, 20)
    df = grid(t, "customer", "c_custkey")
    return df.select("c_custkey", geo.circle_contains("x", "y", circle).alias("near"), F.round(geo.distance_to_circle("x", "y", circle), 6).alias("gap"), geo.ellipse_contains("x", "y", ellipse).alias("in_ellipse"))


@query("SELECT n_regionkey, round(sum(b - greatest(a, coalesce(reached, a))), 6)::DOUBLE AS area FROM (SELECT n_regionkey, a, b, max(b) OVER (PARTITION BY n_regionkey ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (SELECT n_regionkey, n_nationkey * 1.0 AS a, n_nationkey + 5.5 AS b FROM nation)) GROUP BY n_regionkey")
def geo_dissolve(t):
    """Strips that overlap others of their region."""
    a, b = F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + 5.5).cast("string")
    ring = F.concat_ws(", ", F.concat(a, F.lit(" 0")), F.concat(b, F.lit(" 0")), F.concat(b, F.lit(" 1")), F.concat(a, F.lit(" 1")), F.concat(a, F.lit(" 0")))
    df = t("nation").select("n_regionkey", geo.from_wkt(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("g"))
    return geo.dissolve(df, "g", ["n_regionkey"]).select("n_regionkey", F.round(geo.area("g", 3857), 6).alias("area"))
