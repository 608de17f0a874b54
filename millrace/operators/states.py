"""Facts about columns as states that can be stored per part of the data and merged later.

A state is one row per column (and per group): rows, missing values, a distinct-count sketch
(HyperLogLog) and, for numbers, a quantile sketch (KLL), all of bounded size. States of parts merge
into the state of the whole without another look at the rows, so a table that grows by the day needs
one pass per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import clean, dtype, missing, need_batch, quoted
from millrace.selectors import resolve

STATE = ("column", "dtype", "rows", "missing_count", "distinct", "quantiles")
#: log2 of the slots of a distinct-count sketch; a standard error of about 0.8 %.
SLOTS = 14
ACCURACY = 100


def sketch_size(accuracy: int) -> int:
    """The size at which a quantile sketch is off by at most a share 1 / ``accuracy`` of the rows, with 99 % confidence."""
    if accuracy < 1:
        raise ValueError("accuracy is at least 1")
    return min(65_535, max(8, round((2.3 * accuracy) ** 1.11)))


def quantile_state(value: Column, accuracy: int) -> Column:
    """Aggregate: the sketch of the known values as doubles."""
    return F.kll_sketch_agg_double(value.cast("double"), sketch_size(accuracy))


def quantile_of(state: Column, probability: float) -> Column:
    """A quantile out of a sketch; missing without values."""
    return F.when(F.kll_sketch_get_n_double(state) > 0, F.kll_sketch_get_quantile_double(state, F.lit(float(probability))))


def column_states(df: DataFrame, columns=None, by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """The state of every column, per group of ``by``; one pass, only sketches are shuffled. Missing keys are a group."""
    need_batch(df, "column states")
    by = resolve(df, by) if by else []
    names = [c for c in (df.columns if columns is None else resolve(df, columns)) if c not in by]
    if clash := set(by) & set(STATE):
        raise ValueError(f"columns of a state cannot name groups: {sorted(clash)}")
    if not names:
        raise ValueError("no column to look at")
    numbers = {n for n in names if isinstance(dtype(df, n), T.NumericType)}
    found = [F.count(F.lit(1)).alias("__rows")]
    for i, n in enumerate(names):
        found.append(F.count_if(missing(df, n)).alias(f"__m{i}"))
        found.append(F.hll_sketch_agg(clean(df, n).cast("string"), SLOTS).alias(f"__d{i}"))
        if n in numbers:
            found.append(quantile_state(clean(df, n), accuracy).alias(f"__q{i}"))
    one = df.groupBy(*[quoted(k) for k in by]).agg(*found)
    entries = [
        F.struct(
            F.lit(n).alias("column"), F.lit(dtype(df, n).simpleString()).alias("dtype"), F.col("__rows").alias("rows"), F.col(f"__m{i}").alias("missing_count"),
            F.col(f"__d{i}").alias("distinct"), (F.col(f"__q{i}") if n in numbers else F.lit(None).cast("binary")).alias("quantiles"),
        )
        for i, n in enumerate(names)
    ]
    return one.select(*[quoted(k) for k in by], F.explode(F.array(*entries)).alias("__e")).select(*[quoted(k) for k in by], "__e.*")


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of larger parts: those of ``by``, or of the whole. ``states`` may come from several tables stacked."""
    by = list(by)
    return states.groupBy(*[quoted(k) for k in by], "column", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("missing_count").alias("missing_count"),
        F.hll_union_agg("distinct", F.lit(False)).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    ).select(*[quoted(k) for k in by], "column", "dtype", "rows", "missing_count", "distinct", F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.col("quantiles")).alias("quantiles"))


def state_facts(states: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What states say: rows, missing values, about how many distinct values, and quantiles of numbers as an array."""
    others = [c for c in states.columns if c not in STATE]
    found = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.array(*[quantile_of(F.col("quantiles"), p) for p in probabilities]))
    unique = F.least(F.hll_sketch_estimate("distinct"), F.col("rows") - F.col("missing_count"))
    return states.select(*[quoted(c) for c in others], "column", "dtype", "rows", "missing_count", unique.alias("unique_count"), found.alias("quantiles"))
