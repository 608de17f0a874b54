"""What to compute for a pair of columns, and the overview of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.contract import as_list, quoted
from millrace.operators.rows import keep_top_values, sample_rows, top_values, value_table
from millrace.plans import profile
from millrace.plans.power import predictive_matrix

FACTS = ("empty", "only_nans", "constant", "id")
CATEGORIES = ("cat2", "cat10", "cat300")
TOP_CATEGORIES = 20


def _few(df: DataFrame, col: str, kind: str, top: int) -> DataFrame:
    return keep_top_values(df, col, top) if kind == "cat300" else df


def _left_out(df: DataFrame, columns: list[str], top: int) -> dict[str, DataFrame]:
    """How many categories and rows the other tables leave out, per column with more than ``top``."""
    parts = []
    for c in columns:
        counts = value_table(df, c)
        kept = top_values(df, c, top).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        whole = counts.agg(F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
        parts.append(whole.select(F.lit(c).alias("column"), (F.col("categories") - kept.select("k").scalar()).alias("categories"), (F.col("rows") - kept.select("n").scalar()).alias("rows")))
    return {"left_out": reduce(DataFrame.unionByName, parts)} if parts else {}


def relate(df: DataFrame, x: str, y: str, x_as_category: bool = False, y_as_category: bool = False, top: int = TOP_CATEGORIES, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables that describe how y depends on x, chosen by what both columns mean.

    Of a column with many categories the ``top`` most frequent are shown one by one; ``left_out`` says how
    many categories and rows the others are, and ``counts`` sums them up in rows of their own. ``by``
    names columns that tell the rows apart, for a scatter of the same points on every run.
    """
    if x == y:
        return {"summary": profile.column_summary(df, [x])}
    kinds = profile.semantic_classes(df, [x, y])
    for name, as_category in ((x, x_as_category), (y, y_as_category)):
        if as_category and kinds[name] == "numeric":
            kinds.update(profile.semantic_classes(df, [name], numbers_as_categories=True))
    a, b = kinds[x], kinds[y]
    if a in FACTS or b in FACTS:
        return {"unique": profile.unique_table(df, x, y), "summary": profile.column_summary(df, [x, y])}
    if a == "datetime" or b == "datetime":
        ts, value, kind = (x, y, b) if a == "datetime" else (y, x, a)
        if kind == "datetime":
            return {"x": profile.time_distribution(df, x), "y": profile.time_distribution(df, y)}
        fns = ("mean",) if kind == "numeric" else ("count", "nunique")
        return {"over_time": profile.over_time(df, ts, value, fns)}
    if a == "numeric" and b == "numeric":
        return {
            "density": profile.density_2d(df, x, y),
            "predictive_density": profile.density_2d(df, x, y, normalize="x"),
            "scatter": sample_rows(df, by=by).select(quoted(x), quoted(y)) if as_list(by) else sample_rows(df.select(quoted(x), quoted(y))),
        }
    many = [n for n in (x, y) if kinds[n] == "cat300"]
    if a == "numeric":
        few = _few(df, y, b, top)
        return {"shares": profile.bin_category_table(few, x, y), "histogram": profile.histogram(few, x, by=y), **_left_out(df, many, top)}
    if b == "numeric":
        few = _few(df, x, a, top)
        return {"boxes": profile.box_stats(few, y, x), "histogram": profile.histogram(few, y, by=x), **_left_out(df, many, top)}
    counts = profile.crosstab(df, x, y, normalize="x", top_x=top if a == "cat300" else None, top_y=top if b == "cat300" else None)
    return {"counts": counts, "unique": profile.unique_table(_few(df, x, a, top), x, y), **_left_out(df, many, top)}


def overview(df: DataFrame, fold_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Column facts, predictor patterns (how well each column tells each other one) and correlations of the whole table.

    ``fold_by`` names the columns that a row's fold depends on when patterns are scored; without it folds are random.
    """
    return {
        "glimpse": profile.glimpse(df),
        "columns": profile.column_summary(df),
        "patterns": predictive_matrix(df, max_columns=len(df.columns), fold_by=fold_by),
        "correlations": profile.correlations(df),
    }


def drill(df: DataFrame, col: str, value) -> DataFrame:
    """The rows behind one line of a table of values."""
    return df.where(F.col(col).eqNullSafe(F.lit(value)))
