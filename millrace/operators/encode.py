"""One-hot and label encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.contract import clean, missing, need_batch, need_order, quoted
from millrace.operators.ordered import number_rows
from millrace.selectors import resolve

MAX_CATEGORIES = 1000


def one_hot(df: DataFrame, columns, drop_first: bool = False, dummy_na: bool = False, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Replace each column by 0/1 columns ``col_value`` in value order."""
    need_batch(df, "one_hot")
    names = resolve(df, columns)
    # one pass over (column, value); the limit keeps what reaches the driver small
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), clean(df, n).cast("string").alias("v")) for n in names]))
    found = df.select(pairs.alias("p")).select("p.*").where("v is not null").distinct()
    rows = found.limit(max_categories * len(names) + 1).collect()
    values: dict[str, list[str]] = {n: [] for n in names}
    for r in rows:
        values[r["c"]].append(r["v"])
    for n, seen in values.items():
        if len(seen) > max_categories or len(rows) > max_categories * len(names):
            raise ValueError(f"{n!r} has more than {max_categories} categories; raise max_categories to allow it")
    out = [quoted(c) for c in df.columns if c not in names]
    for n in names:
        kind = df.schema[n].dataType.typeName()
        order = sorted(values[n]) if kind == "string" else sorted(values[n], key=_as_number)
        marks = [(f"{n}_{v}", F.coalesce(quoted(n).cast("string") == F.lit(v), F.lit(False))) for v in order]
        if dummy_na:
            marks.append((f"{n}_nan", missing(df, n)))
        out += [test.cast("int").alias(name) for name, test in (marks[1:] if drop_first else marks)]
    return df.select(*out)


def _as_number(text: str):
    try:
        return (0, float(text), text)
    except ValueError:
        return (1, 0.0, text)


def label_table(df: DataFrame, col: str, order: str = "value", order_by: Sequence[str] | None = None, start: int = 0) -> DataFrame:
    """Distinct values numbered by value, by frequency (most common first) or by first appearance."""
    rows = df.select(clean(df, col).alias("value"), *[quoted(o).alias(f"__o{i}") for i, o in enumerate(order_by or [])])
    rows = rows.where(F.col("value").isNotNull())
    if order == "value":
        return number_rows(rows.select("value").distinct(), ["value"], "code", start=start)
    if order == "frequency":
        counts = rows.groupBy("value").agg((-F.count(F.lit(1))).alias("__less"))
        return number_rows(counts, ["__less", "value"], "code", start=start).select("value", "code")
    if order == "appearance":
        need_order(df, order_by, "encoding by appearance")
        marks = [f"__o{i}" for i in range(len(order_by))]
        place = F.struct(*[x for m in marks for x in (missing(rows, m).alias(f"{m}_missing"), clean(rows, m).alias(m))])
        firsts = rows.groupBy("value").agg(F.min(place).alias("__first"))
        spread = firsts.select("value", *[F.col("__first").getField(m).alias(m) for m in marks])
        return number_rows(spread, marks, "code", start=start).select("value", "code")
    raise ValueError(f"unknown label order {order!r}")


def label_encode(
    df: DataFrame,
    columns,
    order: str = "value",
    missing_code: int = -1,
    suffix: str = "_label",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``col + suffix`` with the number of the value; missing values get ``missing_code``."""
    need_batch(df, "label_encode")
    result = df
    for n in resolve(df, columns):
        table = label_table(df, n, order, order_by).toDF("__value", n + suffix)
        joined = result.join(table, clean(df, n) == F.col("__value"), "left").drop("__value")
        result = joined.withColumn(n + suffix, F.coalesce(quoted(n + suffix), F.lit(missing_code)))
    return result
