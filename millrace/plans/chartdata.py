"""The tables behind common charts. Rows with a missing value in a used column are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import as_list, dtype, need_columns, quoted
from millrace.operators.binning import bin_index, equal_edges
from millrace.operators.grouping import group_agg
from millrace.operators.missing import drop_missing_rows
from millrace.operators.ordered import Measure, running, slice_rows
from millrace.operators.resample import resample
from millrace.operators.rows import sample_rows, sort_rows
from millrace.plans.profile import box_stats, histogram, histogram_bins, with_total

# chart function -> aggregate
FUNCTIONS = {"count": "size", "sum": "sum", "avg": "mean", "min": "min", "max": "max"}
NORMS = (None, "percent", "probability", "density", "probability density")


def used(df: DataFrame, *columns) -> DataFrame:
    """The columns a chart needs, without incomplete rows."""
    names = list(dict.fromkeys(c for group in columns for c in as_list(group)))
    need_columns(df, names)
    return drop_missing_rows(df.select(*[quoted(n) for n in names]))


def _spec(y: str | None, fn: str) -> dict:
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown chart function {fn!r}; use one of {sorted(FUNCTIONS)}")
    return {"value": (None if fn == "count" else y, FUNCTIONS[fn])}


def histogram_chart(
    df: DataFrame, x: str, y: str | None = None, fn: str = "count", bins: int = 20, norm: str | None = None,
    cumulative: bool = False, groups: Sequence[str] = (),
) -> DataFrame:
    """A function per bin (numbers) or value (anything else) and group, normalised within the group."""
    if norm not in NORMS:
        raise ValueError(f"unknown normalisation {norm!r}; use one of {NORMS}")
    groups = as_list(groups)
    rows = used(df, x, y, groups)
    width: Column = F.lit(1.0)
    if isinstance(dtype(rows, x), T.NumericType):
        lo, hi, size, number = histogram_bins(rows, x, bins=bins)
        width = F.lit(size)
        at = F.least(F.floor((quoted(x).cast("double") - F.lit(lo)) / F.lit(size)), F.lit(number - 1))
        rows = rows.withColumn("__x", F.lit(lo) + at * F.lit(size))
    else:
        rows = rows.withColumn("__x", quoted(x))
    cells = group_agg(rows, [*groups, "__x"], _spec(y, fn))
    cells = cells.withColumn("value", F.col("value").cast("double"))
    if norm is not None:
        share = F.col("value")
        if norm != "density":
            cells = with_total(cells, groups, "value", "__all")
            share = F.try_divide(share, F.col("__all"))
        if norm == "percent":
            share = share * 100
        if norm in ("density", "probability density"):
            share = share / width
        cells = cells.withColumn("value", share)
    if cumulative:
        cells = running(slice_rows(cells, groups, ["__x"]), [Measure("value", "sum", F.col("value"))]).rows()
    return cells.select(*[quoted(g) for g in groups], F.col("__x").alias("x"), F.col("value"))


def _shares(df: DataFrame, x: str, y: str, groups, norm: str | None, extra: Sequence[str] = ()) -> DataFrame:
    rows = used(df, x, y, groups, extra)
    if norm is None:
        return rows
    if norm not in ("fraction", "percent"):
        raise ValueError(f"unknown normalisation {norm!r}")
    whole = with_total(rows, [x], y, "__all")
    share = F.try_divide(quoted(y), F.col("__all")) * F.lit(100.0 if norm == "percent" else 1.0)
    return whole.withColumn("share", share).drop("__all")


def bar_chart(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), norm: str | None = None) -> DataFrame:
    """The bars as they are, or each one's share of all bars at the same x."""
    return _shares(df, x, y, groups, norm)


def line_chart(df: DataFrame, x: str, y, groups: Sequence[str] = (), sort: bool = True) -> DataFrame:
    rows = used(df, x, y, groups)
    return sort_rows(rows, [x]) if sort else rows


def scatter_chart(df: DataFrame, columns: Sequence[str], n: int = 10_000, seed: int = 123, by: Sequence[str] = ()) -> DataFrame:
    """Sampled points of two or more columns (also for strip, 3-D, matrix and parallel charts).

    With ``by``, columns that tell the rows apart, the points are the same on every run.
    """
    if not as_list(by):
        return sample_rows(used(df, columns), n, seed)
    names = need_columns(df, columns)
    points = drop_missing_rows(df.select(*[quoted(c) for c in dict.fromkeys([*names, *need_columns(df, by)])]), names)
    return sample_rows(points, n, seed, by).select(*[quoted(c) for c in names])


def trendline(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group, over all rows."""
    rows = used(df, x, y, groups)
    cx, cy = quoted(x).cast("double"), quoted(y).cast("double")
    return rows.groupBy(*[quoted(g) for g in as_list(groups)]).agg(
        F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r2"), F.count(F.lit(1)).alias("count"),
    )


def pie_chart(df: DataFrame, label: str, value: str | None = None) -> DataFrame:
    """Sum of values (or rows) per label and its share."""
    rows = used(df, label, value)
    total = F.sum(quoted(value)) if value else F.count(F.lit(1))
    slices = rows.groupBy(quoted(label).alias("label")).agg(total.alias("value"))
    whole = with_total(slices, [], "value", "__all")
    return whole.select("label", "value", F.try_divide(F.col("value"), F.col("__all")).alias("share"))


def box_chart(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    return box_stats(used(df, x, y), y, x, total=x is None)


def violin_chart(df: DataFrame, y: str, x: str, bins: int = 20) -> dict[str, DataFrame]:
    """Binned density per class, and the box inside it."""
    rows = used(df, x, y)
    counts = with_total(histogram(rows, y, bins=bins, by=x), ["class"], "count", "__all")
    width = F.col("bin_end") - F.col("bin_start")
    density = counts.select(
        "class", "bin", "bin_start", "bin_end", "count",
        F.try_divide(F.col("count"), F.col("__all") * width).alias("density"),
    )
    return {"density": density, "boxes": box_chart(rows, y, x)}


def density_chart(df: DataFrame, x: str, y: str, z: str | None = None, fn: str = "count", nx: int = 10, ny: int = 10) -> DataFrame:
    """A function of z (or the rows) per cell of an equally cut grid; also the base of contours."""
    rows = used(df, x, y, z)
    cx, cy = quoted(x).cast("double"), quoted(y).cast("double")
    b = rows.agg(F.min(cx), F.max(cx), F.min(cy), F.max(cy)).first()
    if b[0] is None:
        b = (0.0, 1.0, 0.0, 1.0)
    ex, ey = equal_edges(b[0], b[1], nx, "left"), equal_edges(b[2], b[3], ny, "left")
    tagged = rows.select("*", bin_index(cx, ex, "left").alias("x_bin"), bin_index(cy, ey, "left").alias("y_bin"))
    cells = group_agg(tagged, ["x_bin", "y_bin"], _spec(z, fn))
    starts = [F.get(F.array(*[F.lit(v) for v in e[:-1]]), F.col(n)) for e, n in ((ex, "x_bin"), (ey, "y_bin"))]
    return cells.select("x_bin", "y_bin", starts[0].alias("x_start"), starts[1].alias("y_start"), "value")


def area_chart(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), norm: str | None = None) -> DataFrame:
    """Sorted points, optionally as shares of all groups at the same x."""
    return sort_rows(_shares(df, x, y, groups, norm), [x, *as_list(groups)])


def path_counts(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """Rows per combination of categories (parallel categories)."""
    rows = used(df, path)
    return rows.groupBy(*[quoted(p) for p in path]).agg(F.count(F.lit(1)).alias("count"))


def candlestick_chart(
    df: DataFrame, ts: str, value: str | None = None, every: int = 1, unit: str = "D",
    ohlc: Sequence[str] = ("open", "high", "low", "close"), order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Given open/high/low/close columns in time order, or those of one value per period."""
    if value is None:
        return sort_rows(used(df, ts, list(ohlc)), [ts])
    wide = resample(df, ts, every, unit, "ohlc", columns=[value], order_by=order_by, keep_empty=False)
    return wide.toDF(ts, "open", "high", "low", "close")


def treemap_chart(df: DataFrame, path: Sequence[str], value: str | None = None, mode: str = "total") -> DataFrame:
    """Subtotals per path prefix. In ``remainder`` mode only leaves carry a value."""
    if mode not in ("total", "remainder"):
        raise ValueError(f"mode is 'total' or 'remainder', not {mode!r}")
    rows = used(df, path, value)
    sets = [[quoted(p) for p in path[:i]] for i in range(1, len(path) + 1)]
    total = F.sum(quoted(value)) if value else F.count(F.lit(1))
    level = sum((1 - F.grouping(p) for p in path), F.lit(0))
    nodes = rows.groupingSets(sets, *[quoted(p) for p in path]).agg(level.cast("int").alias("level"), total.alias("value"))
    if mode == "remainder":
        nodes = nodes.withColumn("value", F.when(F.col("level") == len(path), F.col("value")).otherwise(F.lit(0)))
    return nodes.select(*[quoted(p) for p in path], "level", "value")
