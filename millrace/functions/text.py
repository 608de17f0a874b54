"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


# a code point that is never a character, and a space
_MARK = "\ufdd0 "


def _big_first(c: Column) -> Column:
    """The first letter as a capital; a letter that becomes two, such as sharp s, gives "Ss"."""
    big = F.upper(F.substr(c, F.lit(1), F.lit(1)))
    return F.concat(F.substr(big, F.lit(1), F.lit(1)), F.lower(F.substr(big, F.lit(2))))


def title(c: Column) -> Column:
    """Every run of letters starts with a capital, whatever stands before it.

    ``initcap`` starts words at spaces only, so one is put before every other start and taken out again.
    """
    spaced = F.regexp_replace(F.lower(c), r"(?<=[^\p{L} ])(?=\p{L})", _MARK)
    return F.replace(F.initcap(spaced), F.lit(_MARK), F.lit(""))


def capitalize(c: Column) -> Column:
    return F.concat(_big_first(c), F.lower(F.substr(c, F.lit(2))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


_SPECIAL = re.compile(r"\\g<(?P<group>\w+)>|\\(?P<number>\d{1,2})|\\(?P<escape>.)|(?P<plain>[\\$\d])", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}


def java_replacement(text: str) -> str:
    r"""A replacement with ``\1``, ``\g<1>`` and ``\g<name>`` references in the form the JVM expects.

    Digits of the text are escaped, as the JVM would take them for part of a group number before them. A
    backslash before any other character than a letter of a control character stands for itself.
    """

    def one(found: re.Match) -> str:
        if group := found["group"] or found["number"]:
            return f"${group}" if group.isdigit() else f"${{{group}}}"
        if (escape := found["escape"]) is not None:
            return _CONTROL.get(escape) or r"\\" + (re.sub(r"[$\d]", r"\\\g<0>", escape) if escape != "\\" else "")
        return "\\" + found["plain"]

    return _SPECIAL.sub(one, text)


def replace(c: Column, find: str, replacement: str, regex: bool = False) -> Column:
    if regex:
        return F.regexp_replace(c, find, java_replacement(replacement))
    return F.replace(c, F.lit(find), F.lit(replacement)) if find else c


def slice_(c: Column, start: int | None, stop: int | None) -> Column:
    """``text[start:stop]`` with open ends and positions counted from the end."""
    size = F.char_length(c)

    def at(i: int | None, default: Column) -> Column:
        if i is None:
            return default
        return F.least(F.lit(i), size) if i >= 0 else F.greatest(size + F.lit(i), F.lit(0))

    begin, end = at(start, F.lit(0)), at(stop, size)
    return F.substr(c, begin + 1, F.greatest(end - begin, F.lit(0)))


def parts(c: Column, separator: str, regex: bool = False, max_splits: int | None = None) -> Column:
    pattern = separator if regex else re.escape(separator)
    return F.split(c, pattern, -1 if not max_splits or max_splits < 0 else max_splits + 1)
