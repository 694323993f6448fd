"""Resampling of an unbounded stream, with late rows up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.groupby import Agg


def resample_stream(df: DataFrame, time: str, every: str, delay: str, *aggs: Agg, keys: list[str] | None = None) -> DataFrame:
    """As the batch operator does, but each interval is final once the watermark has passed it."""
    held = df.withWatermark(time, delay).groupBy(*(keys or []), F.window(time, every))
    out = held.agg(*(a.build().alias(a.name) for a in aggs))
    return out.select(*(keys or []), F.col("window.start").alias(time), *(a.name for a in aggs))
