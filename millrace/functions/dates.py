"""Calendar attributes of a date or timestamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _day(c: Column) -> Column:
    return F.to_date(c)


def _quarter_end(c: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(_day(c), "quarter"), 2))


# fixed values: attribute names, also the suffixes of the new columns
ATTRIBUTES: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month_number": F.month,
    "month_name": lambda c: F.date_format(c, "MMMM"),
    "week": F.weekofyear,
    "dayofyear": F.dayofyear,
    "dayofmonth": F.dayofmonth,
    "dayofweek": F.weekday,
    "weekday_name": lambda c: F.date_format(c, "EEEE"),
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "microsecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)).cast("int"),
    # timestamps hold whole microseconds
    "nanosecond": lambda c: F.when(c.isNotNull(), F.lit(0)),
    "is_leap_year": lambda c: F.dayofyear(F.make_date(F.year(c), F.lit(12), F.lit(31))) == 366,
    "is_year_start": lambda c: (F.month(c) == 1) & (F.dayofmonth(c) == 1),
    "is_year_end": lambda c: (F.month(c) == 12) & (F.dayofmonth(c) == 31),
    "is_quarter_start": lambda c: F.trunc(_day(c), "quarter") == _day(c),
    "is_quarter_end": lambda c: _quarter_end(c) == _day(c),
    "is_month_start": lambda c: F.dayofmonth(c) == 1,
    "is_month_end": lambda c: F.last_day(_day(c)) == _day(c),
    "timestamp": lambda c: F.unix_seconds(c.cast("timestamp")),
}


def attribute(c: Column, name: str) -> Column:
    if name not in ATTRIBUTES:
        raise ValueError(f"unknown date attribute {name!r}; use one of {sorted(ATTRIBUTES)}")
    return ATTRIBUTES[name](c)
