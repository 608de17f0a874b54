"""Dropping and filling missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import clean, dtype, missing, need_batch, need_order, quoted
from millrace.operators.ordered import Measure, running, slice_rows
from millrace.operators.quantiles import quantiles
from millrace.selectors import resolve


def drop_missing_rows(df: DataFrame, subset=None) -> DataFrame:
    names = df.columns if subset is None else resolve(df, subset)
    test = F.lit(True)
    for n in names:
        test = test & ~missing(df, n)
    return df.where(test)


def drop_missing_columns(df: DataFrame, how: str = "all") -> DataFrame:
    """Drop columns that are missing in all rows, or in any row."""
    need_batch(df, "dropping columns by content")
    if how not in ("all", "any"):
        raise ValueError(f"how is 'all' or 'any', not {how!r}")
    holes = [F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(df.columns)]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *holes).first()
    limit = max(counts["rows"], 1) if how == "all" else 1
    return df.select(*[quoted(n) for i, n in enumerate(df.columns) if counts[f"m{i}"] < limit])


def fits(value, kind: T.DataType) -> bool:
    """Whether a Python literal can live in a column of this type unchanged."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, T.NumericType)
    if isinstance(value, float):
        return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) or (
            isinstance(kind, T.NumericType) and value.is_integer()
        )
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def filled_with(df: DataFrame, name: str, value) -> Column:
    kind = dtype(df, name)
    if fits(value, kind):
        return F.coalesce(clean(df, name), F.lit(value).cast(kind))
    if isinstance(kind, T.NumericType) and isinstance(value, float):
        return F.coalesce(clean(df, name).cast("double"), F.lit(value))
    return F.coalesce(clean(df, name).cast("string"), F.lit(value).cast("string"))


def mode_value(df: DataFrame, name: str) -> DataFrame:
    """One row with the most frequent value; the smallest one on ties."""
    counts = df.select(clean(df, name).alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))


def fill_missing(
    df: DataFrame,
    columns,
    value=None,
    how: str = "constant",
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Fill by a constant, mean, median, mode, or the previous (ffill) or next (bfill) known value."""
    names = resolve(df, columns)
    if how == "constant":
        return df.withColumns({n: filled_with(df, n, value) for n in names})
    need_batch(df, f"filling with {how}")
    if how in ("ffill", "bfill"):
        order = need_order(df, order_by, how)
        sliced = slice_rows(df, partition_by, order)
        measures = [Measure(f"__f_{n}", "last", clean(df, n)) for n in names]
        filled = running(sliced, measures, reverse=how == "bfill").rows()
        return filled.select(*[quoted(f"__f_{n}" if n in names else n).alias(n) for n in df.columns])
    if how == "mean":
        stats = df.agg(*[F.avg(clean(df, n)).alias(n) for n in names])
        known = {n: stats.select(quoted(n)).scalar() for n in names}
    elif how == "median":
        stats = quantiles(df, [], {n: (n, [0.5]) for n in names}, accuracy)
        known = {n: stats.select(quoted(n).getItem(0)).scalar() for n in names}
    elif how == "mode":
        known = {n: mode_value(df, n).scalar() for n in names}
        return df.withColumns({n: F.coalesce(clean(df, n), known[n]) for n in names})
    else:
        raise ValueError(f"unknown filling {how!r}")
    return df.withColumns({n: F.coalesce(clean(df, n).cast("double"), known[n]) for n in names})
