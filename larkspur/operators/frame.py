"""Row and column selection, explode, ordering, distinct and set operations.

Where a result depends on row order, an ordering column has to be named: a DataFrame has none of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import ColumnNotFound, SchemaMismatch


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnNotFound(f"no column {', '.join(missing)} in {', '.join(df.columns)}")


def select_cols(df: DataFrame, *names: str) -> DataFrame:
    require(df, names)
    return df.select(*(df[n] for n in names))


def drop(df: DataFrame, *names: str) -> DataFrame:
    require(df, names)
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, [old])
    return df.withColumnRenamed(old, new)


def row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number that rises in the order the source is read; not contiguous, no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ordering(keys: Iterable[str | tuple[str, bool]]) -> list[Column]:
    """Sort columns; (name, True) is descending. Nulls are last in either direction, not-a-number above all values."""
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else F.col(k[0]).desc_nulls_last() if k[1] else F.col(k[0]).asc_nulls_last() for k in keys]


def sort_by(df: DataFrame, *keys: str | tuple[str, bool]) -> DataFrame:
    """Name further columns as tie-breaks for an order that repeats."""
    return df.orderBy(*ordering(keys))


def head(df: DataFrame, n: int, *keys: str | tuple[str, bool]) -> DataFrame:
    return (sort_by(df, *keys) if keys else df).limit(n)


def tail(df: DataFrame, n: int, *keys: str | tuple[str, bool]) -> DataFrame:
    """The last ``n`` rows of an order, in that order."""
    pairs = [(k, False) if isinstance(k, str) else k for k in keys]
    back = [F.col(k).asc_nulls_first() if down else F.col(k).desc_nulls_first() for k, down in pairs]
    return sort_by(df.orderBy(*back).limit(n), *keys)


def take(df: DataFrame, rid: str, ids: list[int]) -> DataFrame:
    """The rows of these ids in this order, as often as they are named; the list is the driver's own and is broadcast."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"_at long, {rid} long")
    return df.join(F.broadcast(wanted), rid).orderBy("_at").drop("_at")


def explode(df: DataFrame, name: str) -> DataFrame:
    """One row per element; a null or empty list gives one row with null."""
    require(df, [name])
    return df.select(*(F.explode_outer(c).alias(c) if c == name else F.col(c) for c in df.columns))


def unique(df: DataFrame, *names: str, order: str | None = None) -> DataFrame:
    """One row for each distinct key, null equal to null: the first in ``order``, any without one."""
    names = names or tuple(df.columns)
    if order is None:
        return df.dropDuplicates(list(names))
    others = [c for c in df.columns if c not in names]
    # a struct minimum is combined before the shuffle, where a window would sort whole groups
    first = df.groupBy(*names).agg(F.min_by(F.struct(*others), F.struct(F.col(order).isNull(), F.col(order))).alias("_first"))
    return first.select(*(F.col(c) if c in names else F.col(f"_first.{c}").alias(c) for c in df.columns))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Counts of each value, null among them: most frequent first, then by value."""
    return df.groupBy(name).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(name))


def n_unique(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_distinct(name).alias(f"{name}_nunique"))


def same_schema(frames: Iterable[DataFrame]) -> None:
    kinds = [[(f.name, f.dataType) for f in df.schema.fields] for df in frames]
    if any(k != kinds[0] for k in kinds):
        raise SchemaMismatch(f"columns differ: {kinds}")


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, repeats included; columns and types must agree."""
    same_schema(frames)
    return reduce(DataFrame.unionAll, frames)


def union(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    return unique(concat(a, b), *names)


def matching(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    keys = b.select(*(F.col(n).alias(f"_{n}") for n in names)).distinct()
    return unique(a.join(keys, reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names)), how), *names)


def intersect(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Distinct rows of ``a`` whose key is in ``b``, null equal to null."""
    if names:
        return matching(a, b, names, "left_semi")
    same_schema([a, b])
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    if names:
        return matching(a, b, names, "left_anti")
    same_schema([a, b])
    return a.subtract(b)

