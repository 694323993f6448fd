"""Grouped aggregation, pivots and custom aggregators.

Groups with a null key are kept, and sums, minima and maxima are double, as are means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns that a pivot makes at most.
MOST_HEADERS = 5_000


@dataclass(frozen=True)
class Agg:
    """One aggregate: ``kind`` of ``column`` ("" counts rows), over the rows where ``where`` is true.

    first, last and mode take ``order``, the column that row order goes by.
    """

    column: str
    kind: str
    alias: str | None = None
    where: Column | None = None
    order: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (f"{self.column}_{self.kind}" if self.column else self.kind)

    def build(self) -> Column:
        value = F.lit(1) if not self.column else F.col(self.column)
        if self.where is not None:
            value = F.when(self.where, value)
        number = value.cast("double")
        if self.kind in ("first", "last"):
            if self.order is None:
                raise ValueError(f"{self.kind} needs the column that row order goes by")
            by = F.when(value.isNotNull(), F.col(self.order))
            return (F.min_by if self.kind == "first" else F.max_by)(value, by)
        made: dict[str, Callable[[], Column]] = {
            "count": lambda: F.count(value),
            "sum": lambda: F.sum(number),
            "mean": lambda: F.avg(number),
            "min": lambda: F.min(number),
            "max": lambda: F.max(number),
            "std": lambda: F.stddev_samp(number),
            "var": lambda: F.var_samp(number),
            "nunique": lambda: F.count_distinct(value),
            "median": lambda: F.median(number),
            "collect_set": lambda: F.sort_array(F.collect_set(value)),
        }
        return made[self.kind]().alias(self.name)


def aggregate(df: DataFrame, keys: list[str], *aggs: Agg) -> DataFrame:
    """One row per key. Modes need counts of values first and are joined on."""
    plain = [a for a in aggs if a.kind != "mode"]
    out = df.groupBy(*keys).agg(*(a.build().alias(a.name) for a in plain)) if plain else df.select(*keys).distinct() if keys else df.groupBy().agg(F.lit(1).alias("_one"))
    for a in (a for a in aggs if a.kind == "mode"):
        found = mode(df if a.where is None else df.filter(a.where), keys, a.column, a.name, a.order)
        same = [out[k].eqNullSafe(found[k]) for k in keys] or F.lit(True)
        out = out.join(found, same, "left").select(*(out[c] for c in out.columns), found[a.name])
    return out.select(*keys, *(a.name for a in aggs))


def mode(df: DataFrame, keys: list[str], name: str, alias: str, order: str | None) -> DataFrame:
    """The most frequent value that isn't null; of equals the one that comes first in ``order``, else the least."""
    tie = F.min(order) if order else F.first(name)
    counted = df.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_n"), tie.alias("_tie"))
    best = F.min_by(name, F.struct(-F.col("_n"), F.col("_tie")))
    return counted.groupBy(*keys).agg(best.alias(alias))


def pivot(df: DataFrame, index: str, header: str, value: str, kind: str = "sum", headers: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One column per distinct ``header``, as text and in text order; null is headed "null". Any kind of aggregate; first, last and mode go by ``order``.

    Naming ``headers`` saves the pass that finds them; more than ``MOST_HEADERS`` are an error, as no schema is that wide.
    """
    df = df.withColumn(header, F.coalesce(F.col(header).cast("string"), F.lit("null")))
    if headers is None:
        headers = sorted(r[0] for r in df.select(header).distinct().limit(MOST_HEADERS + 1).collect())
        if len(headers) > MOST_HEADERS:
            raise ValueError(f"{header} has more than {MOST_HEADERS} values to head columns")
    cells = aggregate(df, [index, header], Agg(value, kind, "_cell", order=order))
    return cells.groupBy(index).pivot(header, headers).agg(F.first("_cell"))


class Aggregator:
    """A custom aggregate in three steps, each over whole pandas batches.

    ``update`` reduces a batch of one group to a partial row, ``merge`` partial rows to one,
    ``finish`` that to the result, so that only partial rows are shuffled.
    """

    partial_schema: str
    result_schema: str

    def update(self, rows: pd.DataFrame) -> dict:
        raise NotImplementedError

    def merge(self, partials: pd.DataFrame) -> dict:
        raise NotImplementedError

    def finish(self, partial: dict) -> dict:
        return partial


def custom(df: DataFrame, keys: list[str], aggregator: Aggregator) -> DataFrame:
    """``aggregator`` by group, with partial results before the shuffle."""
    heads = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def partial(batches):
        for batch in batches:
            rows = [dict(zip(keys, k if isinstance(k, tuple) else (k,))) | aggregator.update(group) for k, group in batch.groupby(keys, dropna=False, sort=False)]
            if rows:
                yield pd.DataFrame(rows)

    def final(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | aggregator.finish(aggregator.merge(rows))])

    return df.mapInPandas(partial, f"{heads}, {aggregator.partial_schema}").groupBy(*keys).applyInPandas(final, f"{heads}, {aggregator.result_schema}")
