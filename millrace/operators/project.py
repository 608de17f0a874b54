"""Choosing, renaming, ordering and deriving columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import as_list, need_columns, put, quoted, unique_names
from millrace.selectors import resolve


def select_columns(df: DataFrame, selection) -> DataFrame:
    return df.select(*[quoted(n) for n in resolve(df, selection)])


def drop_columns(df: DataFrame, selection) -> DataFrame:
    gone = set(resolve(df, selection))
    return df.select(*[quoted(n) for n in df.columns if n not in gone])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    need_columns(df, mapping)
    names = [mapping.get(n, n) for n in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"renaming would repeat a column name: {names}")
    return df.withColumnsRenamed(mapping)


# fixed values: how a tidy column name is formed, applied in this order to the lower-cased name
_WORD_START = re.compile(r"((?<=[a-z0-9])[A-Z]|(?!^)[A-Z](?=[a-z]))")
_SPACING = re.compile(r"[ _-]+")
_PUNCTUATION = re.compile(r"[}{)(><.!?\\:;,-]")


def clean_name(name: str) -> str:
    words = _WORD_START.sub(lambda m: "_" + m.group(0), str(name).strip()).lower()
    return _PUNCTUATION.sub("", _SPACING.sub("_", words))


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([clean_name(n) for n in df.columns]))


def copy_column(df: DataFrame, source: str, target: str) -> DataFrame:
    need_columns(df, [source])
    return put(df, target, quoted(source))


def move_columns(df: DataFrame, columns, where: str, anchor: str | None = None) -> DataFrame:
    """Move columns to ``start`` or ``end``, or ``before`` / ``after`` the anchor."""
    moved = resolve(df, columns)
    rest = [n for n in df.columns if n not in moved]
    if where in ("before", "after"):
        if anchor is None or anchor in moved:
            raise ValueError(f"{where!r} needs an anchor column that is not moved itself")
        at = rest.index(need_columns(df, [anchor])[0]) + (where == "after")
    elif where in ("start", "end"):
        at = 0 if where == "start" else len(rest)
    else:
        raise ValueError(f"unknown place {where!r}")
    return df.select(*[quoted(n) for n in rest[:at] + moved + rest[at:]])


def normalize_names(df: DataFrame) -> DataFrame:
    """Flatten struct columns to ``outer_inner`` and make all names unique."""
    flat: list[tuple[Column, str]] = []

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, f"{name}_{f.name}" if f.name else name)
        else:
            flat.append((c, name))

    for i, f in enumerate(df.schema.fields):
        walk(F.col(f"__{i}"), f.dataType, f.name)
    names = unique_names([n for _, n in flat])
    placed = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return placed.select(*[c.alias(n) for (c, _), n in zip(flat, names)])


def with_formula(df: DataFrame, name: str, formula: str | Column) -> DataFrame:
    """A new or replaced column from an SQL expression or a Column."""
    return put(df, name, F.expr(formula) if isinstance(formula, str) else formula)


def with_udf(df: DataFrame, name: str, fn: Callable, columns, returns: str | T.DataType) -> DataFrame:
    """A Python function per value (one column) or per row (several), in Arrow batches.

    This is the slow path: prefer ``with_formula``.
    """
    columns = need_columns(df, columns)

    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*values) for values in zip(*series)], index=series[0].index, dtype=object)

    udf = F.pandas_udf(apply, returns)
    return put(df, name, udf(*[quoted(c) for c in as_list(columns)]))


def each_column(df: DataFrame, columns, build: Callable[[str], Column], suffix: str = "") -> DataFrame:
    """Apply an expression to several columns, in place or under ``name + suffix``."""
    names: Sequence[str] = resolve(df, columns)
    return df.withColumns({n + suffix: build(n) for n in names})
