"""Cutting a number column into intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contract import clean, need_batch
from millrace.operators.quantiles import quantiles

FEW_EDGES = 64


def bin_index(c: Column, edges: Sequence[float], closed: str = "right", include_lowest: bool = False) -> Column:
    """0-based interval number of a value, NULL outside all intervals."""
    edges = [float(e) for e in edges]
    right = closed == "right"
    if len(edges) <= FEW_EDGES:
        steps = [((c > F.lit(e)) if right else (c >= F.lit(e))).cast("int") for e in edges]
        passed = steps[0]
        for s in steps[1:]:
            passed = passed + s
    else:
        table = F.array(*[F.lit(e) for e in edges])
        passed = F.size(F.filter(table, (lambda e: e < c) if right else (lambda e: e <= c)))
    number = passed - 1
    if right and include_lowest:
        number = F.when(c == F.lit(edges[0]), F.lit(0)).otherwise(number)
    last = len(edges) - 1
    return F.when(c.isNotNull() & (number >= 0) & (number < last), number)


def _rounded(x: float, digits: int) -> float:
    """Round to a number of digits after the point, or significant ones for small fractions."""
    if not math.isfinite(x) or x == 0:
        return x
    fraction, whole = math.modf(x)
    if whole == 0:
        digits = digits - 1 - math.floor(math.log10(abs(fraction)))
    return round(x, digits)


def label_precision(edges: Sequence[float], precision: int = 3) -> int:
    """The smallest precision from the given one up at which all edges look different."""
    for digits in range(precision, 20):
        if len({_rounded(e, digits) for e in edges}) == len(edges):
            return digits
    return precision


def interval_texts(edges: Sequence[float], closed: str = "right", precision: int = 3, include_lowest: bool = False) -> list[str]:
    digits = label_precision(edges, precision)
    shown = [_rounded(float(e), digits) for e in edges]
    if closed == "right" and include_lowest:
        shown[0] = shown[0] - 10 ** (-digits)
    left, right = ("(", "]") if closed == "right" else ("[", ")")
    return [f"{left}{a}, {b}{right}" for a, b in zip(shown, shown[1:])]


def labelled(index: Column, edges: Sequence[float], closed: str, labels, include_lowest: bool) -> Column:
    """Interval texts by default; ``("precision", n)``, ``("asc", first)``, ``("desc", last)`` or a list."""
    count = len(edges) - 1
    if labels is None or labels == "range":
        texts = interval_texts(edges, closed, include_lowest=include_lowest)
    elif isinstance(labels, tuple) and labels[0] == "precision":
        texts = interval_texts(edges, closed, labels[1], include_lowest)
    elif isinstance(labels, tuple) and labels[0] == "asc":
        return index + F.lit(int(labels[1]))
    elif isinstance(labels, tuple) and labels[0] == "desc":
        return F.lit(int(labels[1]) + count - 1) - index
    else:
        texts = [str(x) for x in labels]
        if len(texts) != count:
            raise ValueError(f"{count} intervals need {count} labels, got {len(texts)}")
    return F.get(F.array(*[F.lit(t) for t in texts]), index)


def _bounds(df: DataFrame, col: str) -> tuple[float, float]:
    need_batch(df, "binning by content")
    c = clean(df, col).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        raise ValueError(f"{col!r} has no values to bin")
    return lo, hi


def _checked(closed: str) -> str:
    if closed not in ("right", "left"):
        raise ValueError(f"closed is 'right' or 'left', not {closed!r}")
    return closed


def equal_edges(lo: float, hi: float, bins: int, closed: str = "right") -> list[float]:
    """Equal-width edges; the open end is moved out by 0.1 % of the range so it is included."""
    if bins < 1:
        raise ValueError("bins is at least 1")
    if lo == hi:
        lo -= 0.001 * abs(lo) if lo != 0 else 0.001
        hi += 0.001 * abs(hi) if hi != 0 else 0.001
        return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
    margin = (hi - lo) * 0.001
    if closed == "right":
        edges[0] -= margin
    else:
        edges[-1] += margin
    return edges


def width_edges(lo: float, hi: float, width: float) -> list[float]:
    """Edges every ``width`` from lo; the last edge is hi."""
    if width <= 0:
        raise ValueError("the bin width is above 0")
    edges = [lo + i * width for i in range(max(0, math.ceil((hi - lo) / width)))]
    if not edges or edges[-1] != hi:
        edges.append(hi)
    if len(edges) < 2:
        raise ValueError("the range holds no interval")
    return edges


def _cut(df, col, edges, closed, labels, include_lowest, into) -> DataFrame:
    index = bin_index(clean(df, col).cast("double"), edges, closed, include_lowest)
    return df.withColumn(into or col, labelled(index, edges, closed, labels, include_lowest))


def bin_equal(df: DataFrame, col: str, bins: int, closed: str = "right", labels=None, into: str | None = None) -> DataFrame:
    """A fixed number of equally wide intervals."""
    edges = equal_edges(*_bounds(df, col), bins, _checked(closed))
    return _cut(df, col, edges, closed, labels, False, into)


def bin_width(
    df: DataFrame, col: str, width: float, lo: float | None = None, hi: float | None = None,
    closed: str = "right", labels=None, into: str | None = None,
) -> DataFrame:
    """Intervals of a fixed width from ``lo`` to ``hi`` (by default the column's range)."""
    if lo is None or hi is None:
        low, high = _bounds(df, col)
        lo, hi = low if lo is None else lo, high if hi is None else hi
    edges = width_edges(float(lo), float(hi), float(width))
    return _cut(df, col, edges, _checked(closed), labels, closed == "right", into)


def bin_custom(df: DataFrame, col: str, intervals: Sequence[tuple[float, float, str]], closed: str = "right", into: str | None = None) -> DataFrame:
    """Named intervals that may leave gaps but not overlap."""
    _checked(closed)
    names = [name for _, _, name in intervals]
    if len(set(names)) < len(names):
        raise ValueError(f"interval labels repeat: {names}")
    ordered = sorted(intervals)
    if any(a[1] > b[0] for a, b in zip(ordered, ordered[1:])) or any(a > b for a, b, _ in ordered):
        raise ValueError("intervals overlap or run backwards")
    c = clean(df, col)
    result = F.lit(None).cast("string")
    for a, b, name in reversed(ordered):
        inside = (c > a) & (c <= b) if closed == "right" else (c >= a) & (c < b)
        result = F.when(inside, F.lit(name)).otherwise(result)
    return df.withColumn(into or col, result)


def quantile_edges(df: DataFrame, col: str, q: int, accuracy: int | None = None) -> list[float]:
    edges = quantiles(df, [], {"e": (col, [i / q for i in range(q + 1)])}, accuracy).first()["e"]
    if edges is None or any(e is None for e in edges):
        raise ValueError(f"{col!r} has no values to bin")
    if len(set(edges)) < len(edges):
        raise ValueError(f"quantile edges of {col!r} repeat: {edges}; use fewer quantiles")
    return list(edges)


def bin_quantile(df: DataFrame, col: str, q: int, labels=None, accuracy: int | None = None, into: str | None = None) -> DataFrame:
    """Intervals with about equally many rows; the lowest value is included."""
    need_batch(df, "bin_quantile")
    return _cut(df, col, quantile_edges(df, col, q, accuracy), "right", labels, True, into)


def column_bounds(df: DataFrame, col: str) -> tuple[float, float]:
    return _bounds(df, col)
