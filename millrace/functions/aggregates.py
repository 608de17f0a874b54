"""Column aggregates by name, as expressions that Spark combines on the map side."""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import DATETIMES, clean, dtype, missing, need_order, quoted, truth

# functions that are one aggregate expression
PLAIN = (
    "size", "count", "sum", "mean", "min", "max", "first", "last", "nunique", "std", "var", "sem",
    "skew", "all", "any", "idxmax", "idxmin", "prod",
)
# functions that need more than one pass over the groups
COMPOSED = ("median", "mad", "ngroup")
FUNCTIONS = PLAIN + COMPOSED
ORDERED = ("first", "last", "idxmax", "idxmin")


def place(df: DataFrame, order_by: Sequence[str]) -> Column:
    """The position of a row as one comparable value; missing keys come last."""
    return F.struct(*[x for c in order_by for x in (missing(df, c), clean(df, c))])


#: Lowest value and number of values of the types whose positions fit into one decimal; times are those of the years 1 to 9999.
_RANGES = {
    T.BooleanType: (0, 2), T.ByteType: (-(1 << 7), 1 << 8), T.ShortType: (-(1 << 15), 1 << 16), T.IntegerType: (-(1 << 31), 1 << 32), T.DateType: (-(1 << 31), 1 << 32),
    T.LongType: (-(1 << 63), 1 << 64), T.TimestampType: (-62_135_596_800_000_000, 315_537_897_600_000_000), T.TimestampNTZType: (-62_135_596_800_000_000, 315_537_897_600_000_000),
}


def packed_place(df: DataFrame, order_by: Sequence[str]) -> Column | None:
    """``place`` as one number of fixed width, which keeps an aggregate from sorting; None where the keys do not fit."""
    ranges = [_RANGES.get(type(dtype(df, c))) for c in order_by]
    if None in ranges or math.prod(n + 1 for _, n in ranges) >= 10**38:
        return None
    packed = F.lit(0).cast("decimal(38,0)")
    for c, (lowest, n) in zip(order_by, ranges):
        kind, whole = dtype(df, c), quoted(c)
        if isinstance(kind, T.DateType):
            whole = F.unix_date(whole)
        elif isinstance(kind, DATETIMES):
            whole = F.unix_micros(whole.cast("timestamp"))
        elif isinstance(kind, T.BooleanType):
            whole = whole.cast("int")
        number = lambda x: F.lit(decimal.Decimal(x)).cast("decimal(38,0)")
        place_of = F.coalesce(whole.cast("decimal(38,0)") - number(lowest), number(n))
        packed = (packed * number(n + 1) + place_of).cast("decimal(38,0)")
    return packed


def _pick(df: DataFrame, c: Column, kind: T.DataType, order: Sequence[str], first: bool) -> Column:
    """The first or last known value, rows without a key last; with buffers of fixed width where the types allow it."""
    pick = F.min_by if first else F.max_by
    narrow = (T.NumericType, T.BooleanType, *DATETIMES)
    if not isinstance(kind, narrow):
        return pick(c, F.when(c.isNotNull(), place(df, order)))
    if len(order) == 1 and isinstance(dtype(df, order[0]), narrow):
        known = pick(c, F.when(c.isNotNull(), clean(df, order[0])))
        # rows without a key are equal in order
        rest = (F.min if first else F.max)(F.when(missing(df, order[0]), c))
        return F.coalesce(known, rest) if first else F.coalesce(rest, known)
    packed = packed_place(df, order)
    return pick(c, F.when(c.isNotNull(), place(df, order) if packed is None else packed))


def reversed_key(c: Column, kind: T.DataType) -> Column:
    """A value that sorts the other way round."""
    if isinstance(kind, T.NumericType):
        return -c.cast("decimal(38,9)") if isinstance(kind, T.LongType) else -c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, DATETIMES):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.StringType):
        # code points negated, with an end mark above all of them
        points = F.transform(F.split(c, ""), lambda ch: -F.ascii(ch))
        return F.when(F.length(c) > 0, F.concat(points, F.array(F.lit(1)))).otherwise(F.array(F.lit(1)))
    raise ValueError(f"cannot reverse the order of {kind.simpleString()}")


def skewness(c: Column) -> Column:
    """Sample skewness (bias corrected); 0 for constant groups, NULL below three values."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(corrected)


def plain(
    df: DataFrame,
    column: str | None,
    fn: str,
    order_by: Sequence[str] | None = None,
    label: str | None = None,
    accuracy: int | None = None,
) -> Column:
    """The aggregate expression of a plain function."""
    if fn == "size":
        return F.count(F.lit(1))
    c, kind = clean(df, column), dtype(df, column)
    if isinstance(kind, T.BooleanType) and fn in ("sum", "mean", "std", "var", "sem", "skew", "prod"):
        c = c.cast("int")
    if fn == "count":
        return F.count(c)
    if fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if fn == "mean":
        return F.avg(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn == "nunique":
        if accuracy is not None:
            return F.approx_count_distinct(c, 1.0 / accuracy if accuracy > 25 else 0.05)
        return F.count_distinct(c)
    if fn == "std":
        return F.stddev_samp(c)
    if fn == "var":
        return F.var_samp(c)
    if fn == "sem":
        return F.stddev_samp(c) / F.sqrt(F.count(c))
    if fn == "skew":
        return skewness(c.cast("double"))
    if fn == "prod":
        return F.coalesce(F.product(c), F.lit(1.0))
    if fn == "all":
        return F.coalesce(F.bool_and(truth(c, kind)), F.lit(True))
    if fn == "any":
        return F.coalesce(F.bool_or(truth(c, kind)), F.lit(False))
    order = need_order(df, order_by, fn)
    if fn in ("first", "last"):
        return _pick(df, c, kind, order, fn == "first")
    if fn in ("idxmax", "idxmin"):
        if label is None:
            raise ValueError(f"{fn} returns a row label: pass label=<column>")
        if fn == "idxmin":
            return F.min_by(quoted(label), F.when(c.isNotNull(), F.struct(c, place(df, order))))
        back = [x for o in order for x in (~missing(df, o), reversed_key(clean(df, o), dtype(df, o)))]
        return F.max_by(quoted(label), F.when(c.isNotNull(), F.struct(c, *back)))
    raise ValueError(f"unknown function {fn!r}; use one of {FUNCTIONS}")
