"""Aggregates over partitions, shifts, rolling windows and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.operators.frame import ordering
from larkspur.operators.groupby import Agg, aggregate

#: rolling_by: a time bucket is as long as so many spans, so that one row in so many stands in two.
SPANS = 4

ROLLING: dict[str, Callable] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def broadcast_agg(df: DataFrame, agg: Agg) -> DataFrame:
    """The aggregate of the whole table beside every row: one small row is joined on, nothing is gathered."""
    return df.crossJoin(F.broadcast(aggregate(df, [], agg)))


def over(df: DataFrame, keys: list[str], *aggs: Agg) -> DataFrame:
    """Aggregates of each row's partition beside the row.

    They are grouped first and joined back, so that a hot key is combined before the shuffle and its
    rows can be split over tasks, which a window cannot; adaptive execution broadcasts the groups where they turn out small.
    """
    grouped = aggregate(df, keys, *aggs)
    renamed = grouped.select(*(F.col(k).alias(f"_{k}") for k in keys), *(a.name for a in aggs))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(renamed, same).select(*df.columns, *(a.name for a in aggs))


def ordered(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*ordering(order))


def shift(c: str, n: int, keys: list[str], order: list) -> Column:
    """The value ``n`` rows before (after, if negative) in the partition's order; null beyond its ends."""
    w = ordered(keys, order)
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def diff(c: str, n: int, keys: list[str], order: list) -> Column:
    return F.col(c) - shift(c, n, keys, order)


def rolling(c: str, size: int, kind: str, keys: list[str], order: list) -> Column:
    """Over the last ``size`` rows; null until there are so many. Nulls are skipped."""
    w = ordered(keys, order)
    return F.when(F.row_number().over(w) >= size, ROLLING[kind](c).over(w.rowsBetween(1 - size, 0)))


def rolling_by(df: DataFrame, time: str, span: int, keys: list[str], **columns: tuple[str, str]) -> DataFrame:
    """``df`` with columns, each named ``name=(column, kind)``, over the rows of the closed interval [t - span, t], span in microseconds.

    Rows of equal time count in each other's; nulls are skipped, and a row without time gets nulls.
    A key's rows are dealt by buckets of time, of ``SPANS`` spans each, and those of a bucket's last span stand in the next one too, so that a hot
    key is worked on in many tasks. Sums, means and counts are running totals, to which a value is added at its time and from which it
    is taken after t + span; what is not finite is counted apart. Minima and maxima look at the interval itself.
    """
    t, length = X.micros(time), SPANS * span
    event = lambda bucket, at, sign, own: F.struct(bucket.alias("b"), at.alias("k"), F.lit(sign).alias("s"), F.when(F.lit(own), F.struct(*df.columns)).alias("row"))
    bucket, leaves = F.floor(t / length), F.floor((t + span) / length)
    added, gone = event(bucket, 2 * t, 1, True), event(leaves, 2 * (t + span) + 1, -1, False)
    events = F.when(leaves > bucket, F.array(added, event(leaves, 2 * t, 1, False), gone)).otherwise(F.array(added, gone))
    needed = list(dict.fromkeys(c for c, _ in columns.values()))
    rows = df.filter(F.col(time).isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(needed)), F.explode(events).alias("_e"))
    part = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))), "_e.b").orderBy("_e.k")
    upto, within = part.rangeBetween(Window.unboundedPreceding, 0), part.rangeBetween(-2 * span, 0)
    out = []
    for name, (c, kind) in columns.items():
        v = F.col(f"_v{needed.index(c)}")
        odd = F.isnan(v) | (F.abs(v) == float("inf"))
        count = lambda which: F.sum(F.when(which, F.col("_e.s")).otherwise(0)).over(upto)
        if kind == "count":
            value = count(v.isNotNull())
        elif kind in ("sum", "mean"):
            total = F.sum(F.when(v.isNotNull() & ~odd, v * F.col("_e.s")).otherwise(0.0)).over(upto)
            nans, ups, downs = count(F.isnan(v)), count(v == float("inf")), count(v == float("-inf"))
            total = F.when((nans > 0) | (ups > 0) & (downs > 0), float("nan")).when(ups > 0, float("inf")).when(downs > 0, float("-inf")).otherwise(total)
            n = count(v.isNotNull())
            value = F.when(n > 0, total / n if kind == "mean" else total)
        else:
            value = ROLLING[kind](F.when(F.col("_e.s") > 0, v)).over(within)
        out.append(value.alias(name))
    found = rows.select("_e", *out).filter(F.col("_e.row").isNotNull()).select("_e.row.*", *columns)
    without = df.filter(F.col(time).isNull())
    return found.unionByName(without, allowMissingColumns=True)


def resample(df: DataFrame, time: str, every: int, *aggs: Agg, keys: list[str] | None = None) -> DataFrame:
    """Aggregates by intervals of ``every`` microseconds counted from the epoch in UTC; empty ones are left out, null times too."""
    bucket = X.truncate(time, every).alias(time)
    rows = df.filter(F.col(time).isNotNull())
    return aggregate(rows.withColumn(time, bucket), [*(keys or []), time], *aggs)
