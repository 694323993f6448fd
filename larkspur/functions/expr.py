"""Column expressions whose semantics differ from Spark's own: IEEE division, strict logic, lists, distances.

All are compositions of built-in functions, so that they stay inside code generation and pushdown.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

#: The mean Earth radius in km, and metres per unit.
EARTH_KM = 6371.0088
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048, "nmi": 1852.0}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_null(kind: DataType | str) -> Column:
    return F.lit(None).cast(kind)


def lit_empty_list(element: DataType) -> Column:
    return F.array().cast(ArrayType(element))


def ieee_div(a: Column | str, b: Column | str) -> Column:
    """a / b as double; x/0 is an infinity, 0/0 not a number, null with null."""
    a, b = column(a).cast("double"), column(b).cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def both(a: Column, b: Column) -> Column:
    """AND that is null as soon as one side is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(a & b)


def either(a: Column, b: Column) -> Column:
    """OR that is null as soon as one side is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(a | b)


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """Null where the condition is, rather than the second branch."""
    return F.when(condition.isNull(), None).when(condition, then).otherwise(otherwise)


def as_number(c: Column | str, kind: str) -> Column:
    """Cast between numbers; a timestamp becomes its epoch in microseconds. Out-of-range values raise, as Spark's ANSI mode has it."""
    return column(c).cast(kind)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch; timestamps without a zone count as UTC, which sessions are pinned to."""
    return F.unix_micros(column(c).cast("timestamp"))


def unix_nano(c: Column | str) -> Column:
    return micros(c) * 1000


def bit_and(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseAND(b.cast("long"))


def bit_or(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseOR(b.cast("long"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseXOR(b.cast("long"))


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, unit: str = "km") -> Column:
    """The great-circle distance of points in degrees; null with any null."""
    a1, o1, a2, o2 = (F.radians(column(c).cast("double")) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0)))) * (EARTH_KM * 1000 / METRES[unit])


# lists


def list_len(c: Column | str) -> Column:
    c = column(c)
    return F.when(c.isNotNull(), F.size(c)).cast("long")


def list_get(c: Column | str, i: int) -> Column:
    """Zero-based, negative from the end, null out of range."""
    return F.get(column(c), F.lit(i)) if i >= 0 else F.try_element_at(column(c), F.lit(i))


def list_slice(c: Column | str, begin: int, end: int) -> Column:
    """Half-open and clamped; negative bounds count from the end."""
    c = column(c)
    at = lambda i: F.least(F.lit(i), F.size(c)) if i >= 0 else F.greatest(F.size(c) + i, F.lit(0))
    return F.slice(c, at(begin) + 1, F.greatest(at(end) - at(begin), F.lit(0)))


def list_contains(c: Column | str, value) -> Column:
    """True or false for any list, null elements or not; null for a null list."""
    return F.exists(column(c), lambda x: x.eqNullSafe(F.lit(value)))


def list_sum(c: Column | str, kind: str = "double") -> Column:
    """The sum of the elements that aren't null; null if there are none."""
    kept = F.array_compact(column(c))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0).cast(kind), lambda total, x: total + x.cast(kind)))


def list_mean(c: Column | str) -> Column:
    return list_sum(c) / F.nullif(F.size(F.array_compact(column(c))), F.lit(0))


def list_min(c: Column | str) -> Column:
    return F.array_min(column(c))


def list_max(c: Column | str) -> Column:
    return F.array_max(column(c))


def list_union(a: Column | str, b: Column | str) -> Column:
    """Distinct elements in the order they first come, without nulls."""
    return F.array_compact(F.array_union(column(a), column(b)))


# date and time; components are long and, with a zone, local to it


def local(c: Column | str, zone: str | None = None) -> Column:
    return F.from_utc_timestamp(column(c), zone) if zone else column(c)


def component(c: Column | str, part: str, zone: str | None = None) -> Column:
    """year, month, day, hour, minute, second, weekday (Sunday 0) or day_of_year."""
    c = local(c, zone)
    made = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": lambda x: F.dayofweek(x) - 1, "day_of_year": F.dayofyear}
    return made[part](c).cast("long")


def add_micros(c: Column | str, n: int | Column) -> Column:
    return F.timestamp_micros(micros(c) + n)


def diff_nanos(a: Column | str, b: Column | str) -> Column:
    return (micros(a) - micros(b)) * 1000


def truncate(c: Column | str, every: int) -> Column:
    """Down to a multiple of a fixed interval since the epoch, in UTC."""
    t = micros(c)
    return F.timestamp_micros(t - F.pmod(t, F.lit(every)))


def truncate_calendar(c: Column | str, unit: str, zone: str | None = None) -> Column:
    """To the week (Monday), month or year, in a zone if one is given."""
    cut = F.date_trunc(unit, local(c, zone))
    return F.to_utc_timestamp(cut, zone) if zone else cut


def custom(work: Callable[..., pd.Series], kind: str, *columns: Column | str) -> Column:
    """A scalar function of one's own, over whole pandas batches of the columns."""
    return F.pandas_udf(work, kind)(*map(column, columns))
