"""Filtering, sorting, sampling and paging rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.contract import as_list, clean, missing, need_batch, need_columns, quoted
from millrace.functions.predicates import Condition, all_of
from millrace.operators.ordered import number_rows

SEED = 123
TOP_LIMIT = 100_000


def _joined(conditions) -> Condition:
    return conditions if isinstance(conditions, Condition) else all_of(*conditions)


def filter_rows(df: DataFrame, conditions, how: str = "keep") -> DataFrame:
    """Keep or drop the rows that satisfy a condition (a list means all of them)."""
    test = _joined(conditions).on(df)
    if how == "keep":
        return df.where(test)
    if how == "drop":
        return df.where(~test)
    raise ValueError(f"how is 'keep' or 'drop', not {how!r}")


def filter_report(df: DataFrame, conditions, how: str = "keep") -> DataFrame:
    """Rows before and after a filter in one pass, with the removed share in whole percent."""
    test = _joined(conditions).on(df)
    kept = test if how == "keep" else ~test
    counts = df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    share = F.when(F.col("rows_before") > 0, F.floor(removed * 100 / F.col("rows_before"))).otherwise(F.lit(0))
    return counts.select("*", removed.alias("removed"), share.cast("long").alias("removed_percent"))


def keep_in(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Keep rows whose value occurs in a one-column table: for value lists too long for ``isin``."""
    wanted = values.toDF("__wanted").groupBy("__wanted").agg(F.lit(1).alias("__one"))
    return df.join(wanted, quoted(col).eqNullSafe(F.col("__wanted")), "left_semi")


def sort_rows(df: DataFrame, by: Sequence, as_text: bool = False) -> DataFrame:
    """Sort by ``name`` or ``(name, "asc" | "desc")`` entries; missing values come last either way."""
    need_batch(df, "sorting")
    order = []
    for item in as_list(by) if not isinstance(by, tuple) else [by]:
        name, direction = (item, "asc") if isinstance(item, str) else item
        need_columns(df, [name])
        c = clean(df, name).cast("string") if as_text else clean(df, name)
        order.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return df.orderBy(*order)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def sample_rows(df: DataFrame, n: int = 10_000, seed: int = SEED, by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` random rows without replacement, or all rows if there are fewer.

    ``by`` names columns that tell the rows apart. The sample is then the rows whose key and seed have the
    least digests: one scan in which each task keeps at most n rows, and the same rows however the table
    is partitioned and whichever task is run again. Without it equal rows would share a digest and come
    or stay away together, so rows are drawn by their place, in two scans.
    """
    need_batch(df, "sampling")
    if key := need_columns(df, by):
        digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[quoted(c).cast("string") for c in key]).cast("binary"))
        drawn = df.withColumn("__digest", digest)
        if n <= TOP_LIMIT:
            return drawn.orderBy("__digest", *[quoted(c) for c in key]).limit(n).drop("__digest")
        return number_rows(drawn, ["__digest", *key], "__row").where(F.col("__row") < n).drop("__digest", "__row")
    total = df.count()
    if total <= n:
        return df
    # a thin Bernoulli sample that holds at least n rows (ten standard deviations), then cut to size
    share = min(1.0, (n + 10 * math.sqrt(n) + 50) / total)
    return df.sample(False, share, seed).orderBy(F.rand(seed)).limit(n)


def value_table(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-missing value."""
    return df.where(~missing(df, col)).groupBy(quoted(col)).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values; equal counts are taken in value order."""
    return value_table(df, col).orderBy(F.col("count").desc(), quoted(col).asc()).limit(k)


def keep_top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    # adaptive execution broadcasts the values if their size allows it
    top = top_values(df, col, k).select(quoted(col).alias("__top"))
    return df.join(top, quoted(col) == F.col("__top"), "left_semi")


def page(df: DataFrame, order_by: Sequence[str], offset: int, n: int) -> DataFrame:
    """``n`` rows from position ``offset`` (0-based) in the given order."""
    if offset + n <= TOP_LIMIT:
        return sort_rows(df, order_by).offset(offset).limit(n)
    numbered = number_rows(df, order_by, "__row")
    return numbered.where((F.col("__row") >= offset) & (F.col("__row") < offset + n)).orderBy("__row").drop("__row")


def repeat_rows(df: DataFrame, n: int, chunk: int = 10_000) -> DataFrame:
    """Every row ``n`` times; large numbers are opened in chunks to keep arrays short."""
    if n <= chunk:
        return df.withColumn("__again", F.explode(F.array_repeat(F.lit(True), n))).drop("__again")
    at = df.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(chunk))))
    here = F.least(F.lit(chunk), F.lit(n) - F.col("__at"))
    return at.withColumn("__again", F.explode(F.array_repeat(F.lit(True), here))).drop("__at", "__again")


