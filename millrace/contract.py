"""Shared rules: missing values, row order, column naming and type helpers.

* Missing means NULL, or NaN in a floating point column.
* Row order is never implied. Operators that depend on it take ``order_by`` and refuse streams.
* Sorting always puts missing values last.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def dtype(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; the table has {df.columns}")
    return df.schema[name].dataType


def as_list(value) -> list:
    if value is None:
        return []
    if isinstance(value, (str, Column)):
        return [value]
    return list(value)


def need_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = as_list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}; the table has {df.columns}")
    return names


def need_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs the whole table and cannot run on a stream")


def need_order(df: DataFrame, order_by, what: str) -> list[str]:
    """Check the mandatory row order of an order-dependent operator."""
    need_batch(df, what)
    names = as_list(order_by)
    if not names:
        raise ValueError(f"{what} depends on row order: pass order_by=[...]")
    return need_columns(df, names)


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(dtype(df, name), FLOATS):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = quoted(name)
    if isinstance(dtype(df, name), FLOATS):
        return F.when(~F.isnan(c), c)
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[clean(df, n).alias(n) for n in df.columns])


def truth(c: Column, kind: T.DataType) -> Column:
    """Truthiness: non-zero numbers and non-empty texts are true."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.StringType):
        return F.length(c) > 0
    if isinstance(kind, T.NumericType):
        return c != F.lit(0)
    return c.isNotNull()


def put(df: DataFrame, name: str, c: Column) -> DataFrame:
    return df.withColumn(name, c)


def unique_names(names: Sequence) -> list[str]:
    """Names as strings; later repeats get ``_1``, ``_2`` and so on."""
    taken: set[str] = set()
    result = []
    for raw in names:
        base = str(raw)
        name, i = base, 0
        while name in taken:
            i += 1
            name = f"{base}_{i}"
        taken.add(name)
        result.append(name)
    return result


def spare_name(stem: str, *frames: DataFrame) -> str:
    taken = {c for f in frames for c in f.columns}
    name = stem
    while name in taken:
        name += "_"
    return name


def common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type several columns can share: equal, widened number, timestamp, else text."""
    first = kinds[0]
    if all(k == first for k in kinds):
        return first
    real = [k for k in kinds if not isinstance(k, T.NullType)]
    if not real:
        return first
    if len(real) < len(kinds):
        return common_type(real)
    if all(isinstance(k, T.NumericType) for k in real):
        if any(isinstance(k, FLOATS) for k in real):
            return T.DoubleType()
        decimals = [k for k in real if isinstance(k, T.DecimalType)]
        if decimals:
            scale = max(k.scale for k in decimals)
            whole = max([k.precision - k.scale for k in decimals] + [19])
            return T.DecimalType(min(38, whole + scale), min(scale, 38 - whole))
        return max(real, key=_integer_rank)
    if all(isinstance(k, DATETIMES) for k in real):
        return T.TimestampType()
    return T.StringType()


def _integer_rank(kind: T.DataType) -> int:
    return INTEGERS.index(type(kind)) if type(kind) in INTEGERS else -1


def micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch of a date or timestamp column."""
    return F.unix_micros(c if isinstance(kind, T.TimestampType) else c.cast("timestamp"))


def same(a: Column, b: Column, null_safe: bool = True) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def all_true(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result
