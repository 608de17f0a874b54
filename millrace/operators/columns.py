"""Text, date and type operators on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.contract import dtype, need_batch, quoted
from millrace.functions import casts, dates, text
from millrace.operators.project import each_column
from millrace.selectors import resolve


def split_text(
    df: DataFrame,
    col: str,
    separator: str,
    regex: bool = False,
    max_splits: int | None = None,
    n_parts: int | None = None,
) -> DataFrame:
    """Split into ``col_0``, ``col_1`` and so on; clashing names get ``_x`` (old) and ``_y`` (new).

    Without ``n_parts`` one pass finds the largest number of parts.
    """
    pieces = text.parts(quoted(col), separator, regex, max_splits)
    if n_parts is None:
        need_batch(df, "splitting without n_parts")
        n_parts = df.agg(F.max(F.size(pieces))).first()[0] or 0
        n_parts = max(n_parts, 0)
    names = [f"{col}_{i}" for i in range(n_parts)]
    old = df.withColumnsRenamed({n: n + "_x" for n in names if n in df.columns})
    new = [n + "_y" if n in df.columns else n for n in names]
    source = col + "_x" if col in names else col
    pieces = text.parts(quoted(source), separator, regex, max_splits)
    return old.select("*", *[F.get(pieces, F.lit(i)).alias(n) for i, n in enumerate(new)])


def lower(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    return each_column(df, columns, lambda n: F.lower(quoted(n)), suffix)


def upper(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    return each_column(df, columns, lambda n: F.upper(quoted(n)), suffix)


def title(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    return each_column(df, columns, lambda n: text.title(quoted(n)), suffix)


def capitalize(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    return each_column(df, columns, lambda n: text.capitalize(quoted(n)), suffix)


def strip(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    return each_column(df, columns, lambda n: text.strip(quoted(n)), suffix)


def length(df: DataFrame, columns, suffix: str = "_length") -> DataFrame:
    return each_column(df, columns, lambda n: F.char_length(quoted(n)), suffix)


def replace_text(df: DataFrame, col: str, find: str, replacement: str, regex: bool = False, into: str | None = None) -> DataFrame:
    return df.withColumn(into or col, text.replace(quoted(col), find, replacement, regex))


def slice_text(df: DataFrame, col: str, start: int | None = None, stop: int | None = None, into: str | None = None) -> DataFrame:
    return df.withColumn(into or col, text.slice_(quoted(col), start, stop))


def date_attribute(df: DataFrame, col: str, name: str, into: str | None = None) -> DataFrame:
    """A calendar attribute as ``col_name``."""
    return df.withColumn(into or f"{col}_{name}", dates.attribute(quoted(col), name))


def cast_column(df: DataFrame, col: str, target: str, format: str | None = None, errors: str | None = None, into: str | None = None) -> DataFrame:
    return df.withColumn(into or col, casts.convert(quoted(col), dtype(df, col), target, format, errors))


def cast_columns(df: DataFrame, selection, target: str, suffix: str = "", format: str | None = None, errors: str | None = None) -> DataFrame:
    names = resolve(df, selection)
    return df.withColumns(
        {n + suffix: casts.convert(quoted(n), dtype(df, n), target, format, errors) for n in names}
    )
