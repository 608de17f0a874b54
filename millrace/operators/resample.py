"""Changing the frequency of a time series: aggregate per period, or fill a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import DATETIMES, all_true, clean, dtype, missing, need_batch, need_columns, quoted
from millrace.functions.calendar import Frequency, origin, unit_name
from millrace.operators.grouping import drop_missing_keys, group_agg
from millrace.operators.ordered import Measure, running, slice_rows, sort_parts
from millrace.selectors import resolve

FILLS = ("asfreq", "ffill", "bfill", "nearest", "interpolate")
AGGREGATES = (
    "count", "size", "nunique", "sum", "mean", "median", "min", "max", "first", "last", "std", "var",
    "sem", "prod", "ohlc",
)
# what an empty period shows
EMPTY = {"count": 0, "size": 0, "nunique": 0, "sum": 0, "prod": 1.0}
NUMERIC_ONLY = ("sum", "mean", "median", "std", "var", "sem", "prod", "ohlc")
CHUNK = 100_000


def _series(df: DataFrame, ts: str) -> None:
    need_batch(df, "resample")
    if not isinstance(dtype(df, ts), DATETIMES):
        raise ValueError(f"{ts!r} is not a date or time column")


def frequency_of(df: DataFrame, ts: str, every: int, unit: str) -> tuple[Frequency, int, int] | None:
    """The frequency anchored at the first timestamp, with the last bucket; None for an empty table."""
    name = unit_name(unit)
    if every < 1:
        raise ValueError("every is at least 1")
    c = quoted(ts).cast("timestamp")
    first, lo, hi = df.agg(origin(name, F.min(c)), F.unix_micros(F.min(c)), F.unix_micros(F.max(c))).first()
    if first is None:
        return None
    return Frequency(name, every, first), lo, hi


def _grid(df: DataFrame, by: Sequence[str], bucketed: DataFrame, freq: Frequency, lo: int, hi: int) -> DataFrame:
    """All buckets between the first and the last one, per group."""
    spark = df.sparkSession
    if not by:
        ends = spark.range(1).select(
            *[freq.bucket(F.timestamp_micros(F.lit(m))).alias(n) for m, n in ((lo, "a"), (hi, "b"))]
        ).first()
        return spark.range(ends["a"], ends["b"] + 1).select(F.col("id").alias("__bucket"))
    spans = bucketed.groupBy(*[quoted(b) for b in by]).agg(F.min("__bucket").alias("__a"), F.max("__bucket").alias("__b"))
    # long grids are opened in two steps so that one task never writes a whole one
    chunks = spans.select("*", F.explode(F.sequence("__a", "__b", F.lit(CHUNK).cast("long"))).alias("__at"))
    chunks = chunks.repartition(*[quoted(b) for b in by], F.col("__at"))
    end = F.least(F.col("__at") + (CHUNK - 1), F.col("__b"))
    return chunks.select(*[quoted(b) for b in by], F.explode(F.sequence(F.col("__at"), end)).alias("__bucket"))


def _values(df: DataFrame, ts: str, by: Sequence[str], columns, how: str) -> list[str]:
    if columns is not None:
        return resolve(df, columns)
    names = [c for c in df.columns if c != ts and c not in by]
    if how in NUMERIC_ONLY:
        names = [c for c in names if isinstance(dtype(df, c), T.NumericType)]
    return names


def resample(
    df: DataFrame,
    ts: str,
    every: int = 1,
    unit: str = "D",
    how: str = "mean",
    by=None,
    columns=None,
    order_by: Sequence[str] | None = None,
    keep_empty: bool = True,
    accuracy: int | None = None,
) -> DataFrame:
    """Bring a time series to ``every`` units.

    Aggregations give one row per period, empty periods included unless ``keep_empty=False``.
    ``size`` gives a ``count`` column, ``ohlc`` four columns per value. Fills put the rows on the
    grid of period labels: exact matches only, previous, next, nearest row, or a straight line
    between the neighbouring values. ``first``, ``last`` and ``ohlc`` follow time, then ``order_by``.
    Fills need one row per time; with ``order_by`` the last of the rows at a time stands for it (rows
    equal there too: the one with the greatest values).
    """
    _series(df, ts)
    by = resolve(df, by) if by is not None else []
    rows = drop_missing_keys(df.where(~missing(df, ts)), by)
    anchored = frequency_of(rows, ts, every, unit)
    names = _values(df, ts, by, columns, how)
    if how in FILLS:
        return _fill(rows, ts, by, names, how, anchored, list(order_by or []))
    if how not in AGGREGATES:
        raise ValueError(f"unknown calculation {how!r}; use one of {FILLS + AGGREGATES}")
    freq, lo, hi = anchored or (Frequency(unit_name(unit), every, 0), 0, 0)
    bucketed = rows.withColumn("__bucket", freq.bucket(quoted(ts)))
    order = [ts, *(order_by or [])]
    if how == "size":
        spec = {"count": (None, "size")}
    elif how == "ohlc":
        spec = {
            f"{n}_{out}": (n, fn)
            for n in names
            for out, fn in (("open", "first"), ("high", "max"), ("low", "min"), ("close", "last"))
        }
    else:
        spec = {n: (n, how) for n in names}
    result = group_agg(bucketed, [*by, "__bucket"], spec, order_by=order, keep_null_keys=True, accuracy=accuracy)
    outs = list(spec)
    if keep_empty and anchored:
        grid = _grid(df, by, bucketed, freq, lo, hi)
        on = all_true([quoted(b).eqNullSafe(F.col(f"__g{i}")) for i, b in enumerate(by)] + [F.col("__bucket") == F.col("__gb")])
        keyed = result.withColumnsRenamed({**{b: f"__g{i}" for i, b in enumerate(by)}, "__bucket": "__gb"})
        result = grid.join(keyed, on, "left")
        if how in EMPTY:
            result = result.withColumns({o: F.coalesce(quoted(o), F.lit(EMPTY[how])) for o in outs})
    label = freq.label(F.col("__bucket")).alias(ts)
    return result.select(*[quoted(b) for b in by], label, *[quoted(o) for o in outs])


def _has_duplicates(rows: DataFrame, keys: Sequence[str]) -> bool:
    repeated = rows.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return not repeated.isEmpty()


def _last_at_time(rows: DataFrame, keys: Sequence[str], names: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per time; an aggregate, so that a time with very many rows is combined before the shuffle."""
    order = need_columns(rows, order_by) + [n for n in names if isinstance(dtype(rows, n), T.AtomicType)]
    picked = rows.groupBy(*[quoted(k) for k in keys]).agg(
        F.max_by(F.struct(*[quoted(n).alias(f"v{i}") for i, n in enumerate(names)]), F.struct(*sort_parts(rows, order, "o"))).alias("__last"))
    return picked.select(*[quoted(k) for k in keys], *[F.col(f"__last.v{i}").alias(n) for i, n in enumerate(names)])


def _fill(rows: DataFrame, ts: str, by: list[str], names: list[str], how: str, anchored, order_by: list[str]) -> DataFrame:
    out_columns = [*by, ts, *names]
    if anchored is None:
        return rows.select(*[quoted(c) for c in out_columns])
    if order_by:
        rows = _last_at_time(rows, [*by, ts], names, order_by)
    elif _has_duplicates(rows, [*by, ts]):
        raise ValueError(f"{ts!r} has duplicates: fill calculations need one row per time, or order_by")
    if how == "interpolate":
        texts = [n for n in names if not isinstance(dtype(rows, n), T.NumericType)]
        if texts:
            raise ValueError(f"only numbers can be interpolated, not {texts}")
    freq, lo, hi = anchored
    kind = rows.schema[ts].dataType
    bucketed = rows.select(*[quoted(b) for b in by], quoted(ts)).withColumn("__bucket", freq.bucket(quoted(ts)))
    grid = _grid(rows, by, bucketed, freq, lo, hi).select(
        *[quoted(b) for b in by], freq.label(F.col("__bucket")).cast(kind).alias(ts)
    )
    if how == "asfreq":
        on = all_true([quoted(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, ts])])
        keyed = rows.select(*[quoted(c).alias(f"__k{i}") for i, c in enumerate([*by, ts])], *[quoted(n) for n in names])
        return grid.join(keyed, on, "left").select(*[quoted(c) for c in out_columns])

    # rows and grid points in one ordered table; a row sorts before a grid point at the same time
    values = F.struct(F.unix_micros(quoted(ts).cast("timestamp")).alias("t"), *[clean(rows, n).alias(n) for n in names])
    both = rows.select(*[quoted(b) for b in by], quoted(ts), F.lit(0).alias("__grid"), values.alias("__row"))
    points = grid.select("*", F.lit(1).alias("__grid"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"))
    sliced = slice_rows(both.unionAll(points), by, [ts, "__grid"])
    if how == "interpolate":
        known = {n: F.when(F.col("__row").getField(n).isNotNull(), F.struct(F.col("__row").getField("t").alias("t"), F.col("__row").getField(n).cast("double").alias("v"))) for n in names}
        sliced = running(sliced, [Measure(f"__p{i}", "last", known[n]) for i, n in enumerate(names)])
        sliced = running(sliced, [Measure(f"__n{i}", "last", known[n]) for i, n in enumerate(names)], reverse=True)
        at = F.unix_micros(quoted(ts).cast("timestamp"))
        filled = [_on_line(F.col(f"__p{i}"), F.col(f"__n{i}"), at).alias(n) for i, n in enumerate(names)]
    else:
        sliced = running(sliced, [Measure("__prev", "last", F.col("__row"))])
        if how == "ffill":
            chosen = F.col("__prev")
        else:
            sliced = running(sliced, [Measure("__next", "last", F.col("__row"))], reverse=True)
            at = F.unix_micros(quoted(ts).cast("timestamp"))
            prev, later = F.col("__prev"), F.col("__next")
            exact = prev.getField("t") == at
            if how == "bfill":
                chosen = F.when(exact, prev).otherwise(later)
            else:
                # the later row wins when both are equally near
                nearer = later.isNull() | (at - prev.getField("t") < later.getField("t") - at)
                chosen = F.when(exact | nearer, prev).otherwise(later)
        filled = [chosen.getField(n).alias(n) for n in names]
    points = sliced.df.where(F.col("__grid") == 1)
    return points.select(*[quoted(b) for b in by], quoted(ts), *filled)


def _on_line(prev: Column, later: Column, at: Column) -> Column:
    """Value on the line between two known points; the last one is kept at the end."""
    t0, v0, t1, v1 = prev.getField("t"), prev.getField("v"), later.getField("t"), later.getField("v")
    between = v0 + (v1 - v0) * (at - t0) / (t1 - t0)
    return F.when((t0 == at) | later.isNull(), v0).when(t0 < t1, between)
