"""Profiles of a table: one or two aggregation passes, small tables out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.contract import DATETIMES, FLOATS, INTEGERS, all_true, as_list, clean, dtype, missing, need_batch, quoted
from millrace.functions.aggregates import plain
from millrace.functions.calendar import FIXED
from millrace.operators.binning import bin_index, equal_edges, interval_texts
from millrace.operators.grouping import attach, drop_missing_keys, group_agg
from millrace.operators.ordered import Measure, running, slice_rows
from millrace.operators.quantiles import column_sizes, fits_one_task, percentile, quantiles
from millrace.operators.resample import resample
from millrace.operators.rows import top_values, value_table
from millrace.plans.comoments import pair_correlations
from millrace.selectors import of_type, resolve

# fixed value: up to this many distinct values a column counts as low-cardinality
FEW_CATEGORIES = 20


def with_total(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` per key; joined instead of windowed, so a hot key is not collected."""
    keys = list(keys)
    if not keys:
        return counts.withColumn(out, counts.agg(F.sum(quoted(value))).scalar())
    totals = counts.groupBy(*[quoted(k) for k in keys]).agg(F.sum(quoted(value)).alias(out))
    totals = totals.toDF(*[f"__t{i}" for i in range(len(keys))], out)
    on = quoted(keys[0]).eqNullSafe(F.col("__t0"))
    for i, k in enumerate(keys[1:], 1):
        on = on & quoted(k).eqNullSafe(F.col(f"__t{i}"))
    return counts.join(totals, on, "left").drop(*[f"__t{i}" for i in range(len(keys))])


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def _fingerprint(df: DataFrame, name: str) -> list[Column]:
    """A key that tells values apart, as (whole number, real number, text) of which one is set.

    Long texts and nested values are hashed so that whole ones need not be shuffled.
    """
    kind, c = dtype(df, name), clean(df, name)
    whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        short = F.concat(F.lit("="), c.cast("string"))
        text = F.when(F.length(c) <= 32, short).otherwise(F.sha2(c.cast("binary"), 256))
        if isinstance(kind, T.BinaryType):
            text = F.sha2(c, 256)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(c)).cast("binary"), 256))
    elif isinstance(kind, FLOATS):
        real = c.cast("double")
    elif isinstance(kind, (*INTEGERS, T.BooleanType)):
        whole = c.cast("long")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(c).cast("long")
    elif isinstance(kind, DATETIMES):
        whole = F.unix_micros(c.cast("timestamp"))
    else:
        text = c.cast("string")
    return [whole.alias("w"), real.alias("r"), text.alias("t")]


def glimpse(df: DataFrame, columns=None, exact: bool = True) -> DataFrame:
    """Type, distinct and missing values of every column.

    ``exact=False`` replaces the distinct count by a sketch, in a single pass without a shuffle.
    """
    need_batch(df, "glimpse")
    names = df.columns if columns is None else resolve(df, columns)
    kinds = {n: dtype(df, n).simpleString() for n in names}
    if exact:
        entry = F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), *_fingerprint(df, n)) for i, n in enumerate(names)])
        )
        counts = df.select(entry.alias("e")).groupBy("e.i", "e.w", "e.r", "e.t").agg(F.count(F.lit(1)).alias("n"))
        known = F.coalesce(F.col("w").isNotNull() | F.col("r").isNotNull() | F.col("t").isNotNull(), F.lit(False))
        facts = counts.groupBy("i").agg(
            F.sum("n").alias("rows"),
            F.count_if(known).alias("unique_count"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        )
    else:
        one = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.approx_count_distinct(clean(df, n)).alias(f"u{i}") for i, n in enumerate(names)],
            *[F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)],
        )
        entry = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"), F.col("rows"), F.col(f"u{i}").alias("unique_count"),
                        F.col(f"m{i}").alias("missing_count"),
                    )
                    for i in range(len(names))
                ]
            )
        )
        facts = one.select(entry.alias("e")).select("e.*")
    at = F.col("i")
    return facts.select(
        (at + 1).alias("position"),
        F.get(F.array(*[F.lit(n) for n in names]), at).alias("column"),
        F.get(F.array(*[F.lit(kinds[n]) for n in names]), at).alias("dtype"),
        F.col("unique_count"),
        _percent(F.col("unique_count"), F.col("rows")).alias("unique_percent"),
        F.col("missing_count"),
        _percent(F.col("missing_count"), F.col("rows")).alias("missing_percent"),
    )


def column_summary(df: DataFrame, columns=None) -> DataFrame:
    """Type, valid, distinct and missing values, for one column or several."""
    g = glimpse(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.select(
        "position", "column", "dtype", (total - F.col("missing_count")).alias("valid_count"),
        "unique_count", "unique_percent", "missing_count", "missing_percent",
    )


def missing_rows(df: DataFrame, col: str) -> DataFrame:
    """The rows where the column is missing."""
    return df.where(missing(df, col))


def missing_report(df: DataFrame, col: str) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing(df, col)).alias("missing_count"))
    return counts.select("*", _percent(F.col("missing_count"), F.col("rows")).alias("missing_percent"))


def value_counts(df: DataFrame, col: str, top: int | None = 10) -> DataFrame:
    """Values by frequency with share, running count and running share; ``top=None`` gives all."""
    need_batch(df, "value_counts")
    counts = value_table(df, col).withColumn("__less", -F.col("count"))
    if top is None:
        sliced = slice_rows(counts, [], ["__less", col])
        total = Measure("__all", "total", F.col("count"))
    else:
        best = counts.orderBy("__less", quoted(col)).limit(top)
        best = best.withColumn("__whole", df.agg(F.count_if(~missing(df, col))).scalar())
        sliced = slice_rows(best, [], ["__less", col], rows=top)
        total = Measure("__all", "last", F.col("__whole"))
    numbered = running(
        sliced, [Measure("cumulative_count", "sum", F.col("count")), total, Measure("rank", "count", F.lit(1))]
    )
    return numbered.df.select(
        "rank", quoted(col), "count", _percent(F.col("count"), F.col("__all")).alias("percent"),
        "cumulative_count", _percent(F.col("cumulative_count"), F.col("__all")).alias("cumulative_percent"),
    )


def numeric_stats(df: DataFrame, col: str, by=None, accuracy: int | None = None) -> DataFrame:
    """min, quartiles, max, mean and standard deviation."""
    keys = resolve(df, by) if by is not None else []
    return _stats(drop_missing_keys(df, keys), col, keys, accuracy, null_keys=False)


def _stats(rows: DataFrame, col: str, keys: list[str], accuracy: int | None, null_keys: bool) -> DataFrame:
    spec = {"count": (col, "count"), "min": (col, "min"), "max": (col, "max"), "mean": (col, "mean"), "std": (col, "std")}
    cuts = [0.25, 0.5, 0.75]
    sizes = None if accuracy is not None else column_sizes(rows, [col])
    if sizes is None or fits_one_task(rows, sizes[col]):
        one = rows.groupBy(*[quoted(k) for k in keys]).agg(
            *[plain(rows, c, fn).alias(out) for out, (c, fn) in spec.items()], percentile(rows, col, cuts, accuracy).alias("__q")
        )
    else:
        base = group_agg(rows, keys, spec, keep_null_keys=null_keys)
        one = attach(base, quantiles(rows, keys, {"__q": (col, cuts)}, null_safe=null_keys, sizes=sizes), keys, ["__q"], null_keys)
    q = [F.get(F.col("__q"), F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return one.select(*[quoted(k) for k in keys], "count", "min", *q, "max", "mean", "std")


def sign_counts(df: DataFrame, col: str) -> DataFrame:
    c = clean(df, col)
    return df.agg(
        F.count_if(c > 0).alias("positive"), F.count_if(c == 0).alias("zero"), F.count_if(c < 0).alias("negative")
    )


def semantic_classes(df: DataFrame, columns=None, numbers_as_categories: bool = False) -> dict[str, str]:
    """What a column means for plotting: empty, only_nans, constant, datetime, cat2, numeric, cat10, id, cat300.

    An id has more than a few categories and no value twice.
    """
    facts = {r["column"]: r for r in glimpse(df, columns).collect()}
    names = df.columns if columns is None else resolve(df, columns)
    result = {}
    for n in names:
        kind, seen = dtype(df, n), facts[n]["unique_count"] if n in facts else 0
        if n not in facts:
            result[n] = "empty"
        elif seen == 0:
            result[n] = "only_nans"
        elif seen == 1:
            result[n] = "constant"
        elif isinstance(kind, DATETIMES):
            result[n] = "datetime"
        elif isinstance(kind, T.BooleanType):
            result[n] = "cat2"
        elif isinstance(kind, T.NumericType) and not numbers_as_categories:
            result[n] = "numeric"
        elif seen <= 2:
            result[n] = "cat2"
        elif seen <= FEW_CATEGORIES:
            result[n] = "cat10"
        else:
            rows = round(seen * 100 / facts[n]["unique_percent"])
            result[n] = "id" if seen >= rows - facts[n]["missing_count"] else "cat300"
    return result


def readable_width(least: float) -> float:
    """The smallest of 1, 2.5 or 5 times a power of ten that is at least ``least``."""
    power = math.floor(math.log10(least)) - 1  # one lower, as logarithms round
    choices = (float(f"{digit}e{power + k}") for k in range(4) for digit in (1, 2.5, 5))
    return next(width for width in choices if width >= least * (1 - 1e-12))


def histogram_bins(df: DataFrame, col: str, lo=None, hi=None, bins: int = 20) -> tuple[float, float, float, int]:
    """(lowest, highest, width, number) of readable bins. Infinite values lie in no bin; bounds must be finite."""
    if lo is None or hi is None:
        c = clean(df, col).cast("double")
        c = F.when(F.abs(c) < F.lit(math.inf), c)
        low, high = df.agg(F.min(c), F.max(c)).first()
        lo, hi = low if lo is None else lo, high if hi is None else hi
    lo, hi = float(0 if lo is None else lo), float(0 if hi is None else hi)
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo > hi:
        raise ValueError(f"a histogram needs finite bounds in order, not {lo} and {hi}")
    if lo == hi:
        hi = lo + max(1.0, abs(lo) * 1e-9)
    width = readable_width((hi - lo) / bins)
    return lo, hi, width, max(1, math.ceil((hi - lo) / width))


def _bin_number(c: Column, lo: float, hi: float, width: float, number: int) -> Column:
    at = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(number - 1))
    return F.when((c >= F.lit(lo)) & (c <= F.lit(hi)), at.cast("int"))


def histogram(df: DataFrame, col: str, lo=None, hi=None, bins: int = 20, by: str | None = None) -> DataFrame:
    """Rows per readable bin, empty bins included; per class with shared edges if ``by`` is given."""
    need_batch(df, "histogram")
    rows = df.where(~missing(df, col))
    if by is not None:
        rows = rows.where(~missing(df, by))
    lo, hi, width, number = histogram_bins(rows, col, lo, hi, bins)
    tagged = rows.select(
        *([quoted(by).alias("class")] if by else []),
        _bin_number(quoted(col).cast("double"), lo, hi, width, number).alias("bin"),
    ).where(F.col("bin").isNotNull())
    keys = ["class", "bin"] if by else ["bin"]
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    if by:
        classes = counts.select(F.col("class").alias("__c")).distinct()
        grid = classes.select("__c", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("__b"))
        on = (F.col("__c") == F.col("class")) & (F.col("__b") == F.col("bin"))
    else:
        grid = df.sparkSession.range(number).select(F.col("id").cast("int").alias("__b"))
        on = F.col("__b") == F.col("bin")
    start = F.lit(lo) + F.col("__b") * F.lit(width)
    return grid.join(counts, on, "left").select(
        *([F.col("__c").alias("class")] if by else []),
        F.col("__b").alias("bin"),
        start.alias("bin_start"),
        (start + F.lit(width)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def fd_bins(df: DataFrame, col: str) -> DataFrame:
    """Number of bins by the Freedman-Diaconis rule."""
    stats = numeric_stats(df, col)
    n = F.col("count").cast("double")
    width = F.lit(2.0) * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3.0))
    count = (
        F.when(F.col("count") < 2, F.lit(1))
        .when(width == 0, F.floor(F.sqrt(n)))
        .otherwise(F.ceil(F.try_divide(F.col("max") - F.col("min"), width)))
    )
    return stats.select(count.cast("int").alias("bins"))


# fixed values: seconds per unit, and the units tried from long to short
UNIT_SECONDS = {"AS": 31_557_600, "MS": 2_629_800, "D": 86_400, "H": 3_600, "min": 60, "S": 1}
FALLING_UNITS = ("AS", "MS", "D", "H")


def _span(df: DataFrame, ts: str) -> float:
    c = quoted(ts).cast("timestamp")
    lo, hi = df.agg(F.unix_micros(F.min(c)), F.unix_micros(F.max(c))).first()
    return 0.0 if lo is None else (hi - lo) / 1e6


def default_frequency(df: DataFrame, ts: str, more_than: int = 20) -> str:
    """The longest unit that gives more than 20 points; minutes if none does."""
    span = _span(df, ts)
    for unit in FALLING_UNITS:
        if span / UNIT_SECONDS[unit] > more_than:
            return unit
    return "min"


def expected_points(df: DataFrame, ts: str, every: int = 1, unit: str = "D") -> int:
    """About how many periods the series spans."""
    seconds = UNIT_SECONDS.get(unit) or FIXED.get(unit, 0) / 1e6
    if not seconds:
        seconds = {"B": 120_960, "W": 604_800, "M": 2_629_800, "SM": 1_314_900, "SMS": 1_314_900,
                   "Q": 7_889_400, "QS": 7_889_400, "A": 31_557_600}[unit]
    return int(_span(df, ts) / (every * seconds))


def time_distribution(df: DataFrame, ts: str, every: int = 1, unit: str | None = None) -> DataFrame:
    """Rows per calendar unit, empty ones included."""
    return resample(df, ts, every, unit or default_frequency(df, ts), "size")


def time_span(df: DataFrame, ts: str) -> DataFrame:
    c = quoted(ts)
    lo, hi = F.min(c), F.max(c)
    seconds = (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / F.lit(1_000_000)
    return df.agg(lo.alias("first"), hi.alias("last"), seconds.alias("span_seconds"))


NUMBER_FUNCTIONS = (
    "count", "size", "nunique", "sum", "mean", "median", "min", "max", "std", "var", "sem", "prod", "first", "last",
)
CATEGORY_FUNCTIONS = ("size", "count", "nunique")


def over_time(
    df: DataFrame, ts: str, col: str, fns: Sequence[str] = ("mean",), every: int = 1, unit: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregates of a column per period; periods without rows are left out."""
    from millrace.operators.resample import frequency_of

    allowed = NUMBER_FUNCTIONS if isinstance(dtype(df, col), T.NumericType) else CATEGORY_FUNCTIONS
    wrong = [f for f in as_list(fns) if f not in allowed]
    if wrong:
        raise ValueError(f"{wrong} cannot be used for {col!r}; use some of {allowed}")
    rows = df.where(~missing(df, ts))
    anchored = frequency_of(rows, ts, every, unit or default_frequency(rows, ts))
    if anchored is None:
        raise ValueError(f"{ts!r} has no values")
    freq = anchored[0]
    bucketed = rows.withColumn("__bucket", freq.bucket(quoted(ts)))
    spec = {f"{col}_{f}": (col, f) for f in as_list(fns)}
    result = group_agg(bucketed, ["__bucket"], spec, order_by=[ts, *(order_by or [])])
    return result.select(freq.label(F.col("__bucket")).alias(ts), *[quoted(o) for o in spec])


def over_all_times(df: DataFrame, col: str, fns: Sequence[str] = ("count",)) -> dict[str, DataFrame]:
    """The same column over every date column of the table."""
    return {ts: over_time(df, ts, col, fns) for ts in of_type("datetime").names(df) if ts != col}


def _texts(edges, index: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in interval_texts(edges, "left", 1)]), index)


def density_2d(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 10, normalize: str | None = None) -> DataFrame:
    """Rows per cell of two equally cut number columns, with both margins; all cells are listed.

    ``normalize="x"`` adds the share of a cell in its x bin.
    """
    need_batch(df, "density_2d")
    rows = df.where(~missing(df, x) & ~missing(df, y))
    cx, cy = quoted(x).cast("double"), quoted(y).cast("double")
    b = rows.agg(F.min(cx), F.max(cx), F.min(cy), F.max(cy)).first()
    if b[0] is None:
        b = (0.0, 1.0, 0.0, 1.0)
    ex, ey = equal_edges(b[0], b[1], nx, "left"), equal_edges(b[2], b[3], ny, "left")
    cells = (
        rows.select(bin_index(cx, ex, "left").alias("i"), bin_index(cy, ey, "left").alias("j"))
        .groupBy("i", "j")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(nx * ny).select(
        F.floor(F.col("id") / ny).cast("int").alias("x_bin"), F.pmod("id", F.lit(ny)).cast("int").alias("y_bin")
    )
    full = grid.join(cells, (F.col("x_bin") == F.col("i")) & (F.col("y_bin") == F.col("j")), "left")
    full = full.select("x_bin", "y_bin", F.coalesce("n", F.lit(0)).alias("count"))
    # at most nx * ny rows from here on
    full = full.select(
        "*",
        F.sum("count").over(Window.partitionBy("x_bin")).alias("x_count"),
        F.sum("count").over(Window.partitionBy("y_bin")).alias("y_count"),
    )
    out = full.select(
        "x_bin", _texts(ex, F.col("x_bin")).alias("x_range"), "y_bin", _texts(ey, F.col("y_bin")).alias("y_range"),
        "count", "x_count", "y_count",
    )
    if normalize == "x":
        share = F.when(F.col("x_count") > 0, F.col("count") / F.col("x_count")).otherwise(F.lit(0.0))
        return out.withColumn("share", share)
    if normalize is not None:
        raise ValueError(f"normalize is 'x' or None, not {normalize!r}")
    return out


def bin_category_table(df: DataFrame, num: str, cat: str, bins: int = 10) -> DataFrame:
    """Rows per number bin and category, with the category's share in its bin."""
    rows = df.where(~missing(df, num) & ~missing(df, cat))
    c = quoted(num).cast("double")
    lo, hi = rows.agg(F.min(c), F.max(c)).first()
    edges = equal_edges(lo or 0.0, 1.0 if hi is None else hi, bins, "left")
    counts = (
        rows.select(bin_index(c, edges, "left").alias("bin"), quoted(cat).alias("category"))
        .groupBy("bin", "category")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = with_total(counts, ["bin"], "count", "bin_count")
    return total.select(
        "bin", _texts(edges, F.col("bin")).alias("range"), "category", "count", "bin_count",
        (F.col("count") / F.col("bin_count")).alias("share"),
    )


def box_stats(df: DataFrame, num: str, cat: str | None = None, total: bool = True) -> DataFrame:
    """Five-number summary with 1.5 IQR whiskers, per category and over all rows."""
    need_batch(df, "box_stats")
    rows = df.where(~missing(df, num))
    kind = dtype(df, cat) if cat else T.StringType()
    whole = F.struct(F.lit(None).cast(kind).alias("category"), F.lit(True).alias("is_total"))
    if cat:
        own = F.struct(quoted(cat).alias("category"), F.lit(False).alias("is_total"))
        places = F.when(missing(df, cat), F.array()).otherwise(F.array(own))
        if total:
            places = F.when(missing(df, cat), F.array(whole)).otherwise(F.array(own, whole))
    else:
        places = F.array(whole)
    # a row counts for its category and for the total; both are summarised in the same pass
    keys = ["category", "is_total"]
    long = rows.select(F.explode(places).alias("p"), quoted(num).cast("double").alias("v")).select("p.*", "v")
    stats = _stats(long, "v", keys, None, null_keys=True)
    iqr = F.col("q3") - F.col("q1")
    fenced = stats.select("*", (F.col("q1") - 1.5 * iqr).alias("__lo"), (F.col("q3") + 1.5 * iqr).alias("__hi"))
    names = [c for c in fenced.columns if c not in keys]
    inside = F.col("v").between(F.col("__lo"), F.col("__hi"))
    boxes = attach(long, fenced, keys, names, null_safe=True).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in stats.columns if c not in keys],
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
    )
    return boxes.select(*keys, *_BOX)


_BOX = ("count", "min", "lower_whisker", "q1", "median", "q3", "upper_whisker", "max", "mean", "std", "outliers")


def _in_top(counts: DataFrame, df: DataFrame, col: str, side: str, k: int | None) -> DataFrame:
    """Categories outside the ``k`` most frequent become a missing value with ``<side>_other`` set."""
    if k is None:
        return counts
    top = top_values(df, col, k).select(quoted(col).alias("__top"))
    marked = counts.join(F.broadcast(top), F.col(side) == F.col("__top"), "left")  # k rows
    return marked.withColumn(side, F.col("__top")).withColumn(f"{side}_other", F.col("__top").isNull()).drop("__top")


def crosstab(df: DataFrame, x: str, y: str, normalize: str | None = None, zeros: bool = False, top_x: int | None = None, top_y: int | None = None) -> DataFrame:
    """Rows per pair of categories that occurs; optionally shares.

    ``normalize`` is "x" (share within x), "y" or "all". ``top_x`` and ``top_y`` keep so many of the most
    frequent categories (equal counts in value order) and sum the others up in a row of their own, whose
    category is missing and whose ``x_other`` or ``y_other`` is true. ``zeros`` adds the pairs that never
    occur, which can be many.
    """
    need_batch(df, "crosstab")
    named = df.where(~missing(df, x) & ~missing(df, y)).select(quoted(x).alias("x"), quoted(y).alias("y"))
    counts = named.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))
    counts = _in_top(_in_top(counts, named, "x", "x", top_x), named, "y", "y", top_y)
    left = ["x"] + ["x_other"] * (top_x is not None)
    right = ["y"] + ["y_other"] * (top_y is not None)
    if top_x is not None or top_y is not None:
        counts = counts.groupBy(*left, *right).agg(F.sum("count").alias("count"))
    if zeros:
        # as many rows as asked for; one side of them as a list
        listed = counts.select(F.struct(*right).alias("__r")).distinct().agg(F.collect_list("__r").alias("__r"))
        grid = counts.select(*left).distinct().withColumn("__r", F.explode(listed.scalar())).select(*left, "__r.*")
        names = [*left, *right]
        grid = grid.withColumnsRenamed({c: f"__g_{c}" for c in names})
        met = grid.join(counts, all_true([F.col(f"__g_{c}").eqNullSafe(F.col(c)) for c in names]), "left")
        counts = met.select(*[F.col(f"__g_{c}").alias(c) for c in names], F.coalesce("count", F.lit(0)).alias("count"))
    if normalize is None:
        return counts.select(*left, *right, "count")
    keys = {"x": left, "y": right, "all": []}[normalize]
    whole = with_total(counts, keys, "count", "__all")
    return whole.select(*left, *right, "count", (F.col("count") / F.col("__all")).alias("share"))


def unique_table(df: DataFrame, x: str, y: str, bins: int | None = None) -> DataFrame:
    """Per value of x (or bin of x): rows and distinct values of y."""
    rows = df.where(~missing(df, x))
    if bins:
        c = quoted(x).cast("double")
        lo, hi = rows.agg(F.min(c), F.max(c)).first()
        edges = equal_edges(lo or 0.0, 1.0 if hi is None else hi, bins, "left")
        rows = rows.withColumn("__x", _texts(edges, bin_index(c, edges, "left")))
    else:
        rows = rows.withColumn("__x", quoted(x))
    return rows.groupBy(F.col("__x").alias("x")).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct(clean(df, y)).alias("unique_count")
    )


def number_columns(df: DataFrame, columns=None, max_columns: int = 100) -> list[str]:
    names = resolve(df, columns) if columns is not None else of_type("number").names(df)
    if len(names) > max_columns:
        raise ValueError(f"{len(names)} columns; choose at most {max_columns}")
    return names


DIRECT_PAIRS = 60


def _pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are known; missing if one of them never varies."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, columns=None, max_columns: int = 100) -> DataFrame:
    """Pearson correlation of every pair of number columns, over the rows where both are known."""
    need_batch(df, "correlations")
    names = number_columns(df, columns, max_columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    value = {n: clean(df, n).cast("double") for n in names}
    if len(pairs) <= DIRECT_PAIRS:
        one = df.agg(*[_pearson(value[a], value[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        entry = F.explode(
            F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
        )
        half = one.select(entry.alias("e")).select("e.*")
    else:
        # many columns: matrices of co-moments, merged
        half = pair_correlations(df, names)
    r = F.when(~F.isnan("r"), F.col("r"))
    both = half.select(
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("x").alias("x"), F.col("y").alias("y"), r.alias("correlation")),
                    F.struct(F.col("y").alias("x"), F.col("x").alias("y"), r.alias("correlation")),
                )
            )
        ).alias("e")
    ).select("e.*")
    # columns without any correlation, not even with themselves, are left out
    alive = both.where((F.col("x") == F.col("y")) & F.col("correlation").isNotNull()).select(F.col("x").alias("__n"))
    both = both.join(F.broadcast(alive), F.col("x") == F.col("__n"), "left_semi")
    return both.join(F.broadcast(alive), F.col("y") == F.col("__n"), "left_semi")
