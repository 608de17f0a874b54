"""Row conditions with two-valued logic.

A missing value fails every condition except "is not equal", "not in" and "is missing". Conditions
never evaluate to NULL, so dropping rows is the exact complement of keeping them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.contract import DATETIMES, FLOATS, dtype, missing, quoted


@dataclass(frozen=True)
class Condition:
    """A named test that becomes a Column once the table is known."""

    text: str
    build: Callable[[DataFrame], Column]

    def on(self, df: DataFrame) -> Column:
        return self.build(df)

    def __and__(self, other: "Condition") -> "Condition":
        return Condition(f"({self.text}) and ({other.text})", lambda df: self.on(df) & other.on(df))

    def __or__(self, other: "Condition") -> "Condition":
        return Condition(f"({self.text}) or ({other.text})", lambda df: self.on(df) | other.on(df))

    def __invert__(self) -> "Condition":
        return Condition(f"not ({self.text})", lambda df: ~self.on(df))


def _known(test: Column, *inputs: Column) -> Column:
    """The test, false where an input is missing; written so that it still reaches the scan."""
    for c in inputs or (test,):
        test = c.isNotNull() & test
    return test


def all_of(*conditions: Condition) -> Condition:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Condition) -> Condition:
    return reduce(lambda a, b: a | b, conditions)


def chain(first: Condition, *rest: tuple[str, Condition]) -> Condition:
    """Strictly left to right: ``chain(a, ("and", b), ("or", c))`` is ``((a) and (b)) or (c)``."""
    result = first
    for word, condition in rest:
        if word not in ("and", "or"):
            raise ValueError(f"join conditions with 'and' or 'or', not {word!r}")
        result = result & condition if word == "and" else result | condition
    return result


def isin(col: str, values: Sequence) -> Condition:
    values = list(values)
    wanted = [v for v in values if v is not None]
    with_missing = len(wanted) < len(values)

    def build(df: DataFrame) -> Column:
        hit = _known(quoted(col).isin(wanted), quoted(col)) if wanted else F.lit(False)
        if isinstance(dtype(df, col), FLOATS):
            hit = hit & ~F.isnan(quoted(col))
        return hit | missing(df, col) if with_missing else hit

    return Condition(f"{col} is one of {values}", build)


def not_in(col: str, values: Sequence) -> Condition:
    inner = isin(col, values)
    return Condition(f"{col} is none of {list(values)}", lambda df: ~inner.on(df))


def _text(df: DataFrame, col: str) -> Column:
    c = quoted(col)
    return c if isinstance(dtype(df, col), T.StringType) else c.cast("string")


def starts_with(col: str, text: str) -> Condition:
    return Condition(f"{col} starts with {text!r}", lambda df: _known(_text(df, col).startswith(text), quoted(col)))


def ends_with(col: str, text: str) -> Condition:
    return Condition(f"{col} ends with {text!r}", lambda df: _known(_text(df, col).endswith(text), quoted(col)))


def contains(col: str, text: str, case: bool = False, regex: bool = False) -> Condition:
    def build(df: DataFrame) -> Column:
        c = _text(df, col)
        if regex:
            return _known(c.rlike(text if case else "(?i)" + text), c)
        if case:
            return _known(c.contains(text), c)
        return _known(F.lower(c).contains(text.lower()), c)

    return Condition(f"{col} contains {text!r}", build)


def is_missing(col: str) -> Condition:
    return Condition(f"{col} is missing", lambda df: missing(df, col))


def is_present(col: str) -> Condition:
    return Condition(f"{col} is not missing", lambda df: ~missing(df, col))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _operand(df: DataFrame, col: str, value) -> Column:
    """The right-hand side: a Column, a formula for numbers, a text literal for dates."""
    if isinstance(value, Column):
        return value
    if isinstance(dtype(df, col), DATETIMES):
        if isinstance(value, (dt.date, dt.datetime)):
            return F.lit(value)
        return F.to_timestamp(F.lit(value))
    if isinstance(value, str) and isinstance(dtype(df, col), T.NumericType):
        return F.expr(value)
    return F.lit(value)


def _literal(df: DataFrame, col: str, value) -> bool:
    return not isinstance(value, (Column, type(None))) and not (
        isinstance(value, str) and isinstance(dtype(df, col), T.NumericType)
    )


def cmp(col: str, op: str, value) -> Condition:
    """Compare with a number, a formula over columns, a date text, or a Column."""
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")

    def build(df: DataFrame) -> Column:
        test = _COMPARE[op](quoted(col), _operand(df, col, value))
        inputs = [quoted(col)] if _literal(df, col, value) else [test]
        # NaN is named in the test, also because file and cache statistics know nothing of it
        real = isinstance(dtype(df, col), FLOATS)
        if op == "!=":
            return inputs[0].isNull() | (F.isnan(quoted(col)) | test if real else test)
        return _known(test & ~F.isnan(quoted(col)) if real else test, *inputs)

    return Condition(f"{col} {op} {value}", build)


def is_true(col: str) -> Condition:
    return Condition(f"{col} is true", lambda df: _known(quoted(col) == F.lit(True), quoted(col)))


def is_false(col: str) -> Condition:
    return Condition(f"{col} is false", lambda df: _known(quoted(col) == F.lit(False), quoted(col)))


def between(col: str, lo=None, hi=None) -> Condition:
    """Inclusive range with open ends."""

    def build(df: DataFrame) -> Column:
        tests = [cmp(col, op, v).on(df) for op, v in ((">=", lo), ("<=", hi)) if v is not None]
        return reduce(lambda a, b: a & b, tests) if tests else ~missing(df, col)

    return Condition(f"{col} between {lo} and {hi}", build)


def formula(sql: str) -> Condition:
    return Condition(sql, lambda df: _known(F.expr(sql)))


_TEXT = ["isin", "not_in", "starts_with", "ends_with", "contains", "is_missing", "is_present"]
_ORDERED = ["<", "<=", "==", "!=", ">", ">=", "between", "is_missing", "is_present"]


def predicates_for(field: T.StructField) -> list[str]:
    """The tests that make sense for a column of this type."""
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return ["is_true", "is_false", "is_missing", "is_present"]
    if isinstance(kind, T.NumericType) or isinstance(kind, DATETIMES):
        return list(_ORDERED)
    if isinstance(kind, T.StringType):
        return list(_TEXT)
    return ["is_missing", "is_present"]
