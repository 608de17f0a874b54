"""Running calculations over ordered rows, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import all_true, as_list, clean, dtype, missing, need_order, quoted
from millrace.operators.ordered import Measure, running, slice_rows


def _number_column(df: DataFrame, col: str) -> None:
    if not isinstance(dtype(df, col), T.NumericType):
        raise ValueError(f"{col!r} is not a number column")


def _grouped(df: DataFrame, by, c: Column) -> Column:
    """Rows whose group is missing have no result."""
    return F.when(all_true([~missing(df, k) for k in by]), c) if by else c


def _run(df: DataFrame, col: str, by, order_by, measures: list[Measure], what: str) -> DataFrame:
    _number_column(df, col)
    order = need_order(df, order_by, what)
    return running(slice_rows(df, as_list(by), order), measures).rows()


def pct_change(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] | None = None, into: str | None = None) -> DataFrame:
    """Relative change to the previous row, after carrying the last known value forward."""
    _number_column(df, col)
    value = clean(df, col).cast("double")
    rows = _run(
        df, col, by, order_by,
        [Measure("__now", "last", value), Measure("__then", "last", value, exclusive=True)],
        "pct_change",
    )
    now, then = F.col("__now"), F.col("__then")
    by_zero = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    change = F.when(then == 0, by_zero).otherwise(F.try_divide(now, then) - 1)
    into = into or f"{col}_pct_change"
    return rows.select(*[quoted(c) for c in df.columns if c != into], _grouped(df, as_list(by), change).alias(into))


def _cumulative(df, col, order_by, by, into, kind) -> DataFrame:
    value = clean(df, col)
    into = into or f"{col}_cum{'sum' if kind == 'sum' else 'prod'}"
    rows = _run(df, col, by, order_by, [Measure("__run", kind, value)], f"a cumulative {kind}")
    result = _grouped(df, as_list(by), F.when(value.isNotNull(), F.col("__run")))
    return rows.select(*[quoted(c) for c in df.columns if c != into], result.alias(into))


def cumulative_sum(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] | None = None, into: str | None = None) -> DataFrame:
    """Running sum; missing rows stay missing and are skipped."""
    return _cumulative(df, col, order_by, by, into, "sum")


def cumulative_product(df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] | None = None, into: str | None = None) -> DataFrame:
    """Running product; missing rows stay missing and are skipped."""
    return _cumulative(df, col, order_by, by, into, "product")
