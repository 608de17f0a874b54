"""Stacking tables and removing duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.contract import FLOATS, clean, common_type, dtype, missing, need_order, quoted, spare_name, unique_names
from millrace.operators.ordered import number_rows
from millrace.selectors import resolve


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Stack tables, aligning columns by name; absent columns are missing, types are widened."""
    if len(frames) < 2:
        raise ValueError("concatenation needs at least two tables")
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {n: common_type([dtype(f, n) for f in frames if n in f.columns]) for n in names}
    aligned = [
        f.select(*[(quoted(n) if n in f.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
        for f in frames
    ]
    result = aligned[0]
    for f in aligned[1:]:
        result = result.unionAll(f)
    return result


def concat_columns(*frames: DataFrame, order_by: Sequence[Sequence[str]]) -> DataFrame:
    """Put tables side by side by row position, each in its own order; short ones are padded."""
    if len(frames) < 2 or len(order_by) != len(frames):
        raise ValueError("pass at least two tables and one order_by list per table")
    names = unique_names([c for f in frames for c in f.columns])
    result, used = None, 0
    for i, (f, order) in enumerate(zip(frames, order_by)):
        need_order(f, order, "concat_columns")
        place = spare_name(f"__place{i}", f)
        mine = names[used : used + len(f.columns)]
        used += len(f.columns)
        numbered = number_rows(f, order, place).toDF(*mine, place)
        if result is None:
            result, at = numbered, place
            continue
        joined = result.join(numbered, F.col(at) == F.col(place), "full")
        result = joined.select(
            *[quoted(c) for c in names[:used]], F.coalesce(F.col(at), F.col(place)).alias("__at")
        )
        at = "__at"
    return result.drop(at)


def drop_duplicates(df: DataFrame, columns=None, keep: str = "first", order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per combination of values.

    Whole-row duplicates need no order. Otherwise the first or last row in ``order_by`` survives;
    it is found by aggregation, so a hot combination is reduced before the shuffle.
    """
    names = df.columns if columns is None else resolve(df, columns)
    rest = [c for c in df.columns if c not in names]
    df = df.withColumns({n: clean(df, n) for n in names if isinstance(dtype(df, n), FLOATS)})
    if not rest:
        return df.dropDuplicates(names)
    if keep not in ("first", "last"):
        raise ValueError(f"keep is 'first' or 'last', not {keep!r}")
    order = need_order(df, order_by, "drop_duplicates on some columns")
    place = F.struct(*[x for c in order for x in (missing(df, c), clean(df, c))])
    pick = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*[quoted(n) for n in names]).agg(pick(F.struct(*[quoted(c) for c in rest]), place).alias("__row"))
    return kept.select(*[(quoted(c) if c in names else F.col("__row").getField(c)).alias(c) for c in df.columns])
