"""Type conversion: strict, or turning unconvertible values into missing ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from millrace.contract import DATETIMES, FLOATS, truth

# fixed values: strftime codes and the date patterns they stand for
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD",
}
# tried in this order when no format is given
DATE_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd MMM yyyy", "yyyyMMdd", "yyyy-MM", "yyyy",
)
# target -> (Spark type, highest value); unsigned targets use the next wider type
UNSIGNED = {
    "uint64": ("decimal(20,0)", 2**64 - 1),
    "uint32": ("long", 2**32 - 1),
    "uint16": ("int", 2**16 - 1),
    "uint8": ("smallint", 2**8 - 1),
}
SIGNED = {"int64": "long", "int32": "int", "int16": "smallint", "int8": "tinyint"}
REAL = {"float64": "double", "float32": "float", "float16": "float"}
ALIASES = {
    "integer": "int64", "float": "float64", "boolean": "bool", "str": "string", "timestamp": "datetime",
    "datetime64[ns]": "datetime", "timedelta64[ns]": "timedelta", "Int64": "int64", "Int32": "int32",
    "Int16": "int16", "Int8": "int8",
}
TARGETS = ("string", "object", "category", "bool", "datetime", "timedelta", *SIGNED, *UNSIGNED, *REAL)


def java_pattern(strftime: str) -> str:
    """A date pattern from a strftime format; other letters are quoted."""
    pieces = re.findall(r"%.|[^%]+", strftime)
    out = []
    for p in pieces:
        if p == "%%":
            out.append("'%'")
        elif p.startswith("%"):
            if p not in STRFTIME:
                raise ValueError(f"unsupported date code {p!r}")
            out.append(STRFTIME[p])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group(0)}'", p))
    return "".join(out)


def _whole(c: Column, kind: T.DataType, spark_type: str, coerce: bool) -> Column:
    """To an integer type, cutting fractions; texts such as "1.7" go through a number."""
    if isinstance(kind, T.StringType):
        trimmed = F.trim(c)
        exact = trimmed.try_cast("decimal(38,0)") if spark_type.startswith("decimal") else trimmed.try_cast(spark_type)
        loose = trimmed.try_cast("double").try_cast(spark_type)
        number = F.coalesce(F.when(trimmed.rlike(r"^[+-]?\d+$"), exact), loose).try_cast(spark_type)
        if coerce:
            return number
        return F.when(number.isNotNull() | c.isNull(), number).otherwise(trimmed.cast(spark_type))
    if isinstance(kind, DATETIMES):
        c = F.unix_micros(c.cast("timestamp")) * 1000
    elif isinstance(kind, FLOATS):
        c = F.when(~F.isnan(c), c)
    return c.try_cast(spark_type) if coerce else c.cast(spark_type)


def _text(c: Column, kind: T.DataType, fmt: str | None) -> Column:
    if fmt and isinstance(kind, DATETIMES):
        return F.date_format(c, java_pattern(fmt))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _datetime(c: Column, kind: T.DataType, fmt: str | None, coerce: bool) -> Column:
    if isinstance(kind, DATETIMES):
        return c.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros(F.floor(c / 1000).cast("long"))  # nanoseconds since the epoch
    patterns = [java_pattern(fmt)] if fmt else list(DATE_PATTERNS)
    parsed = F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in patterns])
    if coerce:
        return parsed
    failed = F.raise_error(F.concat(F.lit("cannot read a date from: "), c)).cast("timestamp")
    return F.when(parsed.isNotNull() | c.isNull(), parsed).otherwise(failed)


_UNITS = {"d(?:ays?)?": 86400, "h(?:ours?|r)?": 3600, "m(?:in(?:utes?)?)?": 60, "s(?:ec(?:onds?)?)?": 1}


def _timedelta(c: Column, kind: T.DataType, coerce: bool) -> Column:
    if isinstance(kind, T.DayTimeIntervalType):
        return c
    if isinstance(kind, T.NumericType):
        seconds = (c.cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
        return F.make_dt_interval(secs=seconds)
    text = F.lower(F.trim(c))
    number = r"(\d+(?:\.\d+)?)"
    clock = r"(\d+):(\d+)(?::(\d+(?:\.\d+)?))?"
    shape = rf"^-?\s*(?:{number}\s*[a-z]+\s*)*(?:{clock})?$"

    def part(pattern: str, group: int, seconds: int) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
        return F.coalesce(found.try_cast("decimal(18,6)") * seconds, F.lit(0).cast("decimal(18,6)"))

    total = sum((part(rf"{number}\s*{unit}\b", 1, sec) for unit, sec in _UNITS.items()), F.lit(0).cast("decimal(18,6)"))
    total = total + part(clock, 1, 3600) + part(clock, 2, 60) + part(clock, 3, 1)
    signed = F.when(text.startswith("-"), -total).otherwise(total).cast("decimal(18,6)")
    parsed = F.when(text.rlike(shape) & (F.length(text) > 0), F.make_dt_interval(secs=signed))
    if coerce:
        return parsed
    failed = F.raise_error(F.concat(F.lit("cannot read a duration from: "), c))
    return F.when(c.isNull() | parsed.isNotNull(), parsed).otherwise(failed.cast("interval day to second"))


def convert(c: Column, kind: T.DataType, target: str, fmt: str | None = None, errors: str | None = None) -> Column:
    """The column converted to a target type name.

    ``errors`` is "coerce" (bad values become missing) or "raise"; by default int64 and float64
    coerce and the others raise.
    """
    target = ALIASES.get(target, target)
    if target not in TARGETS:
        raise ValueError(f"unknown type {target!r}; use one of {TARGETS}")
    coerce = (errors or ("coerce" if target in ("int64", "float64") else "raise")) == "coerce"
    if target in ("string", "object"):
        return _text(c, kind, fmt)
    if target == "category":
        return c
    if target == "bool":
        return truth(c, kind)
    if target == "datetime":
        return _datetime(c, kind, fmt, coerce)
    if target == "timedelta":
        return _timedelta(c, kind, coerce)
    if target in REAL:
        if isinstance(kind, DATETIMES):
            c = F.unix_micros(c.cast("timestamp")) * 1000
        source = F.trim(c) if isinstance(kind, T.StringType) else c
        number = source.try_cast(REAL[target]) if coerce else source.cast(REAL[target])
        return F.when(~F.isnan(number), number)
    if target in SIGNED:
        return _whole(c, kind, SIGNED[target], coerce)
    spark_type, high = UNSIGNED[target]
    wide = _whole(c, kind, "decimal(20,0)" if spark_type.startswith("decimal") else "long", coerce)
    limit = F.lit(str(high)).cast("decimal(20,0)")
    return F.when((wide >= 0) & (wide <= limit), wide).cast(spark_type)
