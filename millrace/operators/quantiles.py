"""Exact quantiles with linear interpolation, per group and column.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is fine for columns
with few distinct values, which one sketch pass checks. Otherwise distinct values are counted,
ranked by a running sum over slices, and the rows holding the wanted ranks are picked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contract import all_true, clean, need_batch, quoted, same
from millrace.operators.ordered import Measure, Sliced, running, slice_rows

DISTINCT_KEY = "millrace.percentileDistinctLimit"
DISTINCT_LIMIT = 50_000
ROWS_KEY = "millrace.percentileRowLimit"
ROWS_LIMIT = 1_000_000


def column_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """About how many distinct values, and how many values, each column has; one pass, no shuffle."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    values = [clean(df, c).cast("double") for c in columns]
    found = df.agg(
        *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values)],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
    ).first()
    return {c: (found[f"d{i}"], found[f"n{i}"]) for i, c in enumerate(columns)}


def fits_one_task(df: DataFrame, size: tuple[int, int]) -> bool:
    """Whether one task may hold a count per distinct value: few of them, or few values in all."""
    distinct, values = size
    conf = df.sparkSession.conf
    return distinct <= int(conf.get(DISTINCT_KEY, str(DISTINCT_LIMIT))) or values <= int(conf.get(ROWS_KEY, str(ROWS_LIMIT)))


def few_values(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns whose quantiles may be computed by one aggregate."""
    return {c for c, size in column_sizes(df, columns).items() if fits_one_task(df, size)}


def percentile(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int | None = None) -> Column:
    """An array of quantiles as one aggregate expression."""
    value = clean(df, column).cast("double")
    if accuracy is not None:
        return F.percentile_approx(value, [float(p) for p in probabilities], accuracy).cast("array<double>")
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities]))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, Sequence[float]]],
    accuracy: int | None = None,
    null_safe: bool = True,
    sizes: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """``wanted`` maps an output name to (column, probabilities); outputs are arrays of doubles.

    ``null_safe=False`` promises keys without NULL, which spares a shuffle. ``sizes`` are those of
    ``column_sizes``, if known.
    """
    need_batch(df, "quantiles")
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    groups = [quoted(k) for k in keys]
    if accuracy is None and sizes is None:
        sizes = column_sizes(df, columns)
    small = {c for c in columns if accuracy is not None or fits_one_task(df, sizes[c])}
    parts = []
    light = {o: w for o, w in wanted.items() if w[0] in small}
    heavy = {o: w for o, w in wanted.items() if w[0] not in small}
    if light or not heavy:
        parts.append(
            df.groupBy(*groups).agg(*[percentile(df, c, ps, accuracy).alias(out) for out, (c, ps) in light.items()])
        )
    for c in dict.fromkeys(c for c, _ in heavy.values()):
        parts.append(_ranked(df, keys, c, sizes[c][1], {o: ps for o, (n, ps) in heavy.items() if n == c}))
    result = parts[0]
    for i, part in enumerate(parts[1:]):
        result = _side_by_side(result, part, keys, f"__k{i}_", null_safe)
    return result.select(*groups, *[quoted(o) for o in wanted])


def _side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str, null_safe: bool) -> DataFrame:
    """Join two results with one row per group; without keys each has a single row."""
    if not keys:
        return a.select("*", *[b.select(quoted(c)).scalar().alias(c) for c in b.columns])
    renamed = b.withColumnsRenamed({k: prefix + k for k in keys})
    on = all_true([same(quoted(k), quoted(prefix + k), null_safe) for k in keys])
    # a side may lack groups without any value, so keep both
    joined = a.join(renamed, on, "full")
    kept = [F.coalesce(quoted(k), quoted(prefix + k)).alias(k) for k in keys]
    return joined.select(*kept, *[quoted(c) for c in a.columns + b.columns if c not in keys])


def _ranked(df: DataFrame, keys: Sequence[str], column: str, rows: int, wanted: dict[str, Sequence[float]]) -> DataFrame:
    groups = [quoted(k) for k in keys]
    values = df.select(*groups, clean(df, column).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = values.groupBy(*groups, F.col("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return _picked(slice_rows(counts, keys, ["__v"], rows, drawn_from=values), keys, wanted)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, count: str, wanted: dict[str, Sequence[float]]) -> DataFrame:
    """Quantiles of a table that says how often each group has which value, a value once; missing ones count as 0."""
    named = counts.select(*[quoted(k) for k in keys], quoted(value).alias("__v"), quoted(count).alias("__n"))
    return _picked(slice_rows(named, keys, ["__v"]), keys, wanted)


def _picked(counts: Sliced, keys: Sequence[str], wanted: dict[str, Sequence[float]]) -> DataFrame:
    """The wanted ranks of counted values."""
    groups = [quoted(k) for k in keys]
    sliced = running(counts, [Measure("__upto", "sum", F.col("__n")), Measure("__all", "total", F.col("__n"))])
    picks, outs = [], []
    for j, (out, ps) in enumerate(wanted.items()):
        items = []
        for i, p in enumerate(ps):
            place = F.lit(float(p)) * (F.col("__all") - 1)
            for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                holds = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
                picks.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{side}{j}_{i}"))
            lo, hi = F.col(f"__lo{j}_{i}"), F.col(f"__hi{j}_{i}")
            at = F.lit(float(p)) * (F.col("__total") - 1)
            share = at - F.floor(at)
            # measured from the nearer neighbour, which rounds better
            items.append(F.when(share < 0.5, lo + (hi - lo) * share).otherwise(hi - (hi - lo) * (1 - share)))
        outs.append(F.array(*items).alias(out))
    picked = sliced.df.groupBy(*groups).agg(F.max("__all").alias("__total"), *picks)
    return picked.select(*groups, *outs)
