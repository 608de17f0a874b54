"""Calendar frequencies as numbered periods.

Every unit maps a timestamp to an integer period number and a period number back to the timestamp
that labels it. Steps of n units, grids of empty periods and joins all work on those integers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

DAY = 86_400_000_000
# fixed values: microseconds per unit of constant length
FIXED = {"D": DAY, "H": 3_600_000_000, "min": 60_000_000, "S": 1_000_000, "ms": 1_000, "us": 1}
ALIASES = {"h": "H", "s": "S", "T": "min", "ME": "M", "QE": "Q", "YS": "AS", "YE": "A", "Y": "A", "SME": "SM"}


@dataclass(frozen=True)
class Unit:
    name: str
    number: Callable[[Column], Column]
    label: Callable[[Column], Column]
    # periods that end on their label gather n units backwards from it
    ends: bool = False


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _days(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long")


def _from_days(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int")).cast("timestamp")


def _months(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def _month_start(months: Column) -> Column:
    return F.make_date(_div(months, 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))


def _div(a: Column, b: int) -> Column:
    """Integer floor division, exact for any long."""
    whole = F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))
    return whole.cast("long")


def _stamp(d: Column) -> Column:
    return d.cast("timestamp")


# 1970-01-05 is a Monday: weeks run Monday to Sunday
def _week(ts: Column) -> Column:
    return _div(_days(ts) - 4, 7)


def _business(ts: Column) -> Column:
    return _week(ts) * 5 + F.least(F.weekday(ts), F.lit(4))


def _business_label(n: Column) -> Column:
    return _from_days(_div(n, 5) * 7 + F.pmod(n, F.lit(5)) + 4)


def _half(ts: Column) -> Column:
    return _months(ts) * 2 + F.when(F.dayofmonth(ts) >= 15, 1).otherwise(0)


def _half_label(n: Column) -> Column:
    return _stamp(F.date_add(_month_start(_div(n, 2)), (F.pmod(n, F.lit(2)) * 14).cast("int")))


def _half_end(ts: Column) -> Column:
    day = F.to_date(ts)
    step = F.when(day == F.last_day(day), 1).when(F.dayofmonth(ts) < 15, -1).otherwise(0)
    return _months(ts) * 2 + step


def _half_end_label(n: Column) -> Column:
    start = _month_start(_div(n, 2))
    return _stamp(F.when(F.pmod(n, F.lit(2)) == 0, F.date_add(start, 14)).otherwise(F.last_day(start)))


def _month_end(months: Column) -> Column:
    return _stamp(F.last_day(_month_start(months)))


UNITS: dict[str, Unit] = {
    u.name: u
    for u in (
        Unit("B", _business, _business_label),
        Unit("W", _week, lambda n: _from_days(n * 7 + 10), ends=True),
        Unit("MS", _months, lambda n: _stamp(_month_start(n))),
        Unit("M", _months, _month_end, ends=True),
        Unit("SMS", _half, _half_label),
        Unit("SM", _half_end, _half_end_label),
        Unit("QS", lambda t: _div(_months(t), 3), lambda n: _stamp(_month_start(n * 3))),
        Unit("Q", lambda t: _div(_months(t), 3), lambda n: _month_end(n * 3 + 2), ends=True),
        Unit("AS", lambda t: F.year(t).cast("long"), lambda n: _stamp(_month_start(n * 12))),
        Unit("A", lambda t: F.year(t).cast("long"), lambda n: _month_end(n * 12 + 11), ends=True),
    )
}


@dataclass(frozen=True)
class Frequency:
    """``every`` units, counted from the period of the first timestamp (``first``)."""

    unit: str
    every: int
    first: int  # microseconds of the origin for fixed units, period number otherwise

    def bucket(self, ts: Column) -> Column:
        """The number of the bucket a timestamp belongs to."""
        if self.unit in FIXED:
            return _div(_micros(ts) - F.lit(self.first), FIXED[self.unit] * self.every)
        unit = UNITS[self.unit]
        offset = unit.number(ts) - F.lit(self.first)
        if self.every == 1:
            return offset
        return _div(offset + (self.every - 1), self.every) if unit.ends else _div(offset, self.every)

    def label(self, bucket: Column) -> Column:
        if self.unit in FIXED:
            return F.timestamp_micros(bucket * F.lit(FIXED[self.unit] * self.every) + F.lit(self.first))
        return UNITS[self.unit].label(bucket * F.lit(self.every) + F.lit(self.first))


def unit_name(unit: str) -> str:
    name = ALIASES.get(unit, unit)
    if name == "N":
        raise ValueError("timestamps hold microseconds: a nanosecond frequency is not available")
    if name not in FIXED and name not in UNITS:
        raise ValueError(f"unknown frequency {unit!r}; use one of {sorted([*FIXED, *UNITS])}")
    return name


def origin(unit: str, ts: Column) -> Column:
    """What ``Frequency.first`` is for a given earliest timestamp: fixed units start at its midnight."""
    name = unit_name(unit)
    if name in FIXED:
        return _days(ts) * F.lit(DAY)
    return UNITS[name].number(ts)
