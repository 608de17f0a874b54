"""Co-moments of many columns, pair by pair, in one pass.

A task folds its batches into one square matrix per statistic, by matrix products of the values and of the
flags that say which are known. For a pair (a, b) the statistics cover the rows where both are known: their
number, the means of both, the sum of squared deviations of a, and the sum of the products of deviations.
Such matrices merge: a task sends one row per column, rows of a column merge in two steps, and nothing is
written out per row and pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.contract import clean

NAMES = ("n", "mean_a", "mean_b", "square", "product")
SCHEMA = "i int, part int, " + ", ".join(f"{n} array<double>" for n in NAMES)
#: Rows of a column first merge in so many groups of tasks.
GROUPS = 64
#: Below this share of the raw squares, what is left after subtracting the mean is rounding.
ROUNDING = 1e-12


def moments(values: np.ndarray) -> np.ndarray:
    """The five matrices of rows of values, NaN where one is missing."""
    known = ~np.isnan(values)
    endless = np.isinf(values)
    flags = known.astype(np.float64)
    finite = np.where(known & ~endless, values, 0.0)
    n_finite = np.maximum((known & ~endless).sum(0), 1)
    low, high = (np.where(known & ~endless, values, edge) for edge in (np.inf, -np.inf))
    # a column that never varies is centred without rounding
    same = low.min(0, initial=np.inf) == high.max(0, initial=-np.inf)
    centre = np.where(same, high.max(0, initial=-np.inf), finite.sum(0) / n_finite)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    apart = np.where(known & ~endless, values - centre, 0.0)
    n = flags.T @ flags
    total, squares, products = apart.T @ flags, (apart * apart).T @ flags, apart.T @ apart
    rows = np.maximum(n, 1)
    square = squares - total * total / rows
    square[square <= ROUNDING * squares] = 0
    product = products - total * total.T / rows
    unknown = (endless.T.astype(np.float64) @ flags + flags.T @ endless) > 0
    square[unknown], product[unknown] = np.nan, np.nan
    mean = centre[:, None] + total / rows
    return np.stack([n, mean, mean.T, square, product])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The statistics of both sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    first, second = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    mean_a = np.where(a[0] > 0, a[1] + first * share, b[1])
    mean_b = np.where(a[0] > 0, a[2] + second * share, b[2])
    return np.stack([n, mean_a, mean_b, a[3] + b[3] + first * first * both, a[4] + b[4] + first * second * both])


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column ``i``: arrays of the statistics with every column, by its place in ``columns``."""

    def fold(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns])
                new = moments(values)
                found = new if found is None else merged(found, new)
        if found is not None:
            part = TaskContext.get().partitionId() % GROUPS
            arrays = [pa.array(list(m), pa.list_(pa.float64())) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array([part] * len(columns), pa.int32()), *arrays], ["i", "part", *NAMES])

    def merge(table: pa.Table) -> pa.Table:
        rows = np.stack([np.array(table.column(n).to_pylist()) for n in NAMES], 1)
        found = rows[0]
        for row in rows[1:]:
            found = merged(found, row)
        return pa.table({"i": table.column("i")[:1], "part": table.column("part")[:1], **{n: pa.array([v.tolist()], pa.list_(pa.float64())) for n, v in zip(NAMES, found)}})

    numbers = df.select(*[clean(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = numbers.mapInArrow(fold, SCHEMA)
    return parts.groupBy("i", "part").applyInArrow(merge, SCHEMA).groupBy("i").applyInArrow(merge, SCHEMA).drop("part")


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``x``, ``y``, ``r`` of every pair, the earlier column first; missing where one of them never varies."""
    found = comoments(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    pairs = found.select(F.col("i"), F.posexplode(F.arrays_zip("square", "product")).alias("j", "m"))
    # the squares of y over the rows where x is known stand in y's own row
    other = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("m.square").alias("square_b"))
    spread = F.sqrt(F.col("m.square")) * F.sqrt(F.col("square_b"))
    return pairs.where("i <= j").join(other, ["i", "j"]).select(F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), F.try_divide(F.col("m.product"), spread).alias("r"))
