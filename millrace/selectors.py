"""Column selectors: rules resolved against the schema on the driver, no job needed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from millrace.contract import DATETIMES, FLOATS, INTEGERS, as_list, need_columns


@dataclass(frozen=True)
class Selector:
    label: str
    keep: Callable[[T.StructField], bool]

    def names(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if self.keep(f)]


def all_columns() -> Selector:
    return Selector("all", lambda f: True)


_KINDS: dict[str, tuple[type, ...]] = {
    "number": (T.NumericType,),
    "integer": INTEGERS,
    "float": FLOATS + (T.DecimalType,),
    "boolean": (T.BooleanType,),
    "string": (T.StringType,),
    "object": (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType),
    "category": (T.StringType,),
    "datetime": DATETIMES,
    "timedelta": (T.DayTimeIntervalType,),
}
_KINDS["string/object"] = _KINDS["object"]


def of_type(kind: str) -> Selector:
    """Columns of a kind: number, integer, float, boolean, string, object, category, datetime, timedelta."""
    if kind not in _KINDS:
        raise ValueError(f"unknown kind {kind!r}; use one of {sorted(_KINDS)}")
    return Selector(f"type {kind}", lambda f: isinstance(f.dataType, _KINDS[kind]))


def matching(pattern: str) -> Selector:
    """Names containing a match of the regular expression; an empty pattern selects nothing."""
    return Selector(f"regex {pattern!r}", lambda f: bool(pattern) and re.search(pattern, f.name) is not None)


def starting_with(text: str) -> Selector:
    return Selector(f"starts with {text!r}", lambda f: f.name.startswith(text))


def ending_with(text: str) -> Selector:
    return Selector(f"ends with {text!r}", lambda f: f.name.endswith(text))


def containing(text: str) -> Selector:
    return Selector(f"contains {text!r}", lambda f: text in f.name)


def cols(*names: str) -> tuple[str, ...]:
    return names


def resolve(df: DataFrame, selection) -> list[str]:
    """Names picked by a name, a selector, or a mixed list of both; first mention wins the place."""
    items = [selection] if isinstance(selection, (str, Selector)) else as_list(selection)
    names: dict[str, None] = {}
    for item in items:
        if isinstance(item, Selector):
            found = item.names(df)
        elif isinstance(item, (list, tuple)):
            found = resolve(df, item)
        else:
            found = need_columns(df, [item])
        names.update(dict.fromkeys(found))
    return list(names)
