"""Replacing values and setting values by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import clean, common_type, dtype, missing, quoted
from millrace.functions.predicates import Condition
from millrace.operators.missing import fits


def _kind_of(df: DataFrame, value) -> T.DataType:
    c = value if isinstance(value, Column) else F.lit(value)
    return df.select(c.alias("v")).schema["v"].dataType


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _either(df: DataFrame, test: Column, yes, no) -> Column:
    """if/else of two operands, cast to their common type."""
    kind = common_type([_kind_of(df, yes), _kind_of(df, no)])
    if isinstance(kind, T.NullType):
        return F.lit(None)
    return F.when(test, _column(yes).cast(kind)).otherwise(_column(no).cast(kind))


def _matches(df: DataFrame, name: str, find) -> Column | None:
    if find is None or (isinstance(find, float) and find != find):
        return missing(df, name)
    if isinstance(find, Column):
        return quoted(name).eqNullSafe(find)
    kind = dtype(df, name)
    if isinstance(find, float) and isinstance(kind, T.NumericType) or fits(find, kind):
        return F.coalesce(quoted(name) == F.lit(find), F.lit(False))
    return None


def replace_value(df: DataFrame, find, replacement, column: str | None = None) -> DataFrame:
    """Replace an exact value in one column, or in every column it could occur in.

    ``find`` and ``replacement`` are literals, None for missing, or a Column.
    """
    changes = {}
    for name in [column] if column else df.columns:
        test = _matches(df, name, find)
        if test is not None:
            changes[name] = _either(df, test, replacement, clean(df, name))
    return df.withColumns(changes) if changes else df


def set_values(df: DataFrame, target: str, condition: Condition | Column, value, **otherwise) -> DataFrame:
    """Set ``target`` where the condition holds; elsewhere keep it, or use ``otherwise=``.

    The condition sees the values from before the change.
    """
    test = condition.on(df) if isinstance(condition, Condition) else F.coalesce(condition, F.lit(False))
    unknown = set(otherwise) - {"otherwise"}
    if unknown:
        raise TypeError(f"unknown arguments {sorted(unknown)}")
    if "otherwise" in otherwise:
        rest = otherwise["otherwise"]
    else:
        rest = quoted(target) if target in df.columns else None
    return df.withColumn(target, _either(df, test, value, rest))
