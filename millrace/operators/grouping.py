"""Group-by with many functions, named outputs and results joined back as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.contract import all_true, clean, missing, need_batch, quoted, same, spare_name
from millrace.functions.aggregates import FUNCTIONS, PLAIN, plain
from millrace.operators.ordered import number_rows
from millrace.operators.quantiles import few_values, percentile, quantiles
from millrace.selectors import resolve

Output = tuple[str, str | None, str]


def outputs(df: DataFrame, spec) -> list[Output]:
    """Normalise a specification to (output, column, function) without repeats.

    ``spec`` is ``{"out": ("column", "fn")}`` or a list of ``(functions, columns)``, whose outputs
    are named ``column_fn``.
    """
    found: list[Output] = []
    if isinstance(spec, dict):
        for out, (column, fn) in spec.items():
            found.append((out or f"{column}_{fn}", column, fn))
    else:
        for fns, selection in spec:
            for column in resolve(df, selection):
                for fn in [fns] if isinstance(fns, str) else fns:
                    found.append((f"{column}_{fn}", column, fn))
    found = list(dict.fromkeys(found))
    names = [o for o, _, _ in found]
    if len(set(names)) < len(names):
        raise ValueError(f"two results would have the same name: {names}")
    for _, column, fn in found:
        if fn not in FUNCTIONS:
            raise ValueError(f"unknown function {fn!r}; use one of {FUNCTIONS}")
        if fn not in ("size", "ngroup"):
            resolve(df, column)
    return found


def attach(result: DataFrame, part: DataFrame, keys: Sequence[str], names: Sequence[str], null_safe: bool) -> DataFrame:
    """Add columns of a table with one row per group. Plain equality keeps the groups where they are."""
    if not keys:
        return result.select("*", *[part.select(quoted(n)).scalar().alias(n) for n in names])
    renamed = part.select(*[quoted(k).alias(f"__p{i}") for i, k in enumerate(keys)], *[quoted(n) for n in names])
    on = all_true([same(quoted(k), F.col(f"__p{i}"), null_safe) for i, k in enumerate(keys)])
    return result.join(renamed, on, "left").drop(*[f"__p{i}" for i in range(len(keys))])


def _mean_deviation(df: DataFrame, keys: Sequence[str], columns: dict[str, str], null_safe: bool) -> DataFrame:
    """Mean absolute deviation around the group mean: the means are joined back to the rows."""
    means = df.groupBy(*[quoted(k) for k in keys]).agg(
        *[F.avg(clean(df, c)).alias(f"__m{i}") for i, c in enumerate(columns.values())]
    )
    names = [f"__m{i}" for i in range(len(columns))]
    rows = attach(df, means, keys, names, null_safe)
    return rows.groupBy(*[quoted(k) for k in keys]).agg(
        *[F.avg(F.abs(clean(df, c) - F.col(m))).alias(out) for m, (out, c) in zip(names, columns.items())]
    )


def drop_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return df
    return df.where(all_true([~missing(df, k) for k in keys]))


def group_agg(
    df: DataFrame,
    keys,
    spec,
    order_by: Sequence[str] | None = None,
    label: str | None = None,
    as_columns: bool = False,
    keep_null_keys: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """Aggregate per group. Rows with a missing key are left out unless ``keep_null_keys``.

    ``first``, ``last``, ``idxmax`` and ``idxmin`` need ``order_by``; the latter two also the
    ``label`` column they return. ``accuracy`` switches median and nunique to sketches.
    ``as_columns`` joins the results back to the rows of the table.
    """
    if as_columns:
        need_batch(df, "joining aggregates back")
    keys = resolve(df, keys)
    wanted = outputs(df, spec)
    rows = df if keep_null_keys else drop_missing_keys(df, keys)
    groups = [quoted(k) for k in keys]
    simple = {o: plain(df, c, fn, order_by, label, accuracy) for o, c, fn in wanted if fn in PLAIN}
    medians = {o: c for o, c, fn in wanted if fn == "median"}
    light = set(medians.values()) if accuracy is not None else few_values(rows, list(medians.values()))
    simple.update({o: F.get(percentile(df, c, [0.5], accuracy), F.lit(0)) for o, c in medians.items() if c in light})
    medians = {o: (c, [0.5]) for o, c in medians.items() if c not in light}
    deviations = {o: c for o, c, fn in wanted if fn == "mad"}
    numbers = [o for o, _, fn in wanted if fn == "ngroup"]

    if simple:
        result = rows.groupBy(*groups).agg(*[e.alias(o) for o, e in simple.items()])
    elif keys:
        result = rows.select(*groups).distinct()
    else:
        result = rows.sparkSession.range(1).select()
    if medians:
        part = quantiles(rows, keys, medians, null_safe=keep_null_keys)
        part = part.select(*groups, *[quoted(o).getItem(0).alias(o) for o in medians])
        result = attach(result, part, keys, list(medians), keep_null_keys)
    if deviations:
        result = attach(result, _mean_deviation(rows, keys, deviations, keep_null_keys), keys, list(deviations), keep_null_keys)
    if numbers:
        # number the reduced table of groups, not the rows
        numbered = number_rows(result, keys, numbers[0])
        result = numbered.select("*", *[quoted(numbers[0]).alias(n) for n in numbers[1:]])
    result = result.select(*groups, *[quoted(o) for o, _, _ in wanted])
    if not as_columns:
        return result
    clash = {o: spare_name(o + "_y", df) for o, _, _ in wanted if o in df.columns}
    result = result.withColumnsRenamed(clash)
    names = [c for c in result.columns if c not in keys]
    joined = attach(rows, result, keys, names, keep_null_keys)
    return joined.select(*[quoted(c) for c in df.columns], *[quoted(n) for n in names])




def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
