"""Cross-tabulation with margins, and long to wide / wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from millrace.contract import clean, common_type, dtype, need_batch, need_columns, quoted
from millrace.functions.aggregates import PLAIN, plain
from millrace.operators.grouping import drop_missing_keys, group_agg, stacked
from millrace.operators.missing import drop_missing_columns
from millrace.operators.quantiles import few_values, quantiles_of_counts
from millrace.operators.states import quantile_of, quantile_state
from millrace.selectors import resolve
from millrace.session import settled

MAX_COLUMNS = 1000


def distinct_values(df: DataFrame, names: Sequence[str], limit: int, what: str) -> list[tuple]:
    """Sorted distinct combinations, refused beyond ``limit`` because each becomes a column."""
    found = df.select(*[quoted(n) for n in names]).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{what} would create more than {limit} columns; raise the limit to allow it")
    return sorted(tuple(r) for r in found)


def pivot_table(
    df: DataFrame,
    rows,
    cols,
    value: str,
    agg: str = "mean",
    margins: bool = False,
    margins_name: str = "All",
    fill_value=None,
    keep_all_null_columns: bool = False,
    precision: int | None = None,
    max_columns: int = MAX_COLUMNS,
    order_by: Sequence[str] | None = None,
    label: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Rows x columns table of one aggregate. Margins are computed from the rows, not from cells.

    ``accuracy`` switches medians to sketches, off by about a share 1 / ``accuracy`` of the rows; one
    aggregate then serves cells and margins, whose sketches are merged from those of the cells.
    """
    need_batch(df, "pivot_table")
    rows, cols = resolve(df, rows), resolve(df, cols)
    if not rows:
        raise ValueError("a pivot table needs at least one row field")
    base = drop_missing_keys(df, rows + cols)
    head = F.concat_ws("_", *[quoted(c).cast("string") for c in cols]) if cols else F.lit(agg)
    # headings are texts that Spark made, as the cells' are, whatever the type
    combos = distinct_values(base.withColumn("__head", head), [*cols, "__head"], max_columns, "the pivot table") if cols else []
    heads = [c[-1] for c in combos] if cols else [agg]
    if len(set(heads)) < len(heads):
        raise ValueError(f"two column combinations have the same heading: {heads}")

    tagged = base.withColumn("__head", head)
    texts = {r: quoted(r).cast("string") for r in rows}
    if margins:
        if cols and margins_name in heads or not base.where(texts[rows[0]] == margins_name).isEmpty():
            raise ValueError(f"{margins_name!r} is a value of a row or column field; choose another margins_name")
        tagged = tagged.select("*", *[texts[r].alias(f"__row{i}") for i, r in enumerate(rows)])
        marks = [f"__row{i}" for i in range(len(rows))]
        headings = heads + ([margins_name] if cols else [])
        total_row = [F.lit(margins_name)] + [F.lit("")] * (len(rows) - 1)
        levels = [(True, True), (True, False), (False, True), (False, False)] if cols else [(True, True), (False, True)]
        parts = []
        sketched = agg == "median" and accuracy is not None
        if agg in PLAIN or sketched:
            sets = [
                ([quoted(m) for m in marks] if by_row else []) + ([F.col("__head")] if by_col else [])
                for by_row, by_col in levels
            ]
            if sketched:
                states = tagged.groupBy(*[quoted(m) for m in marks], "__head").agg(quantile_state(clean(df, value), accuracy).alias("__s"))
                tagged, cell = states, quantile_of(F.kll_merge_agg_double("__s"), 0.5)
            else:
                cell = plain(df, value, agg, order_by, label)
            cube = tagged.groupingSets(sets, *[quoted(m) for m in marks], F.col("__head")).agg(
                F.grouping(marks[0]).alias("__gr"),
                F.grouping("__head").alias("__gc"),
                cell.alias("__v"),
            )
            parts.append(
                cube.select(
                    *[F.when(F.col("__gr") == 1, t).otherwise(quoted(m)).alias(m) for m, t in zip(marks, total_row)],
                    F.when(F.col("__gc") == 1, F.lit(margins_name)).otherwise(F.col("__head")).alias("__head"),
                    F.col("__v"),
                )
            )
        elif agg == "median":
            parts.append(_medians_with_margins(tagged, marks, total_row, levels, value, margins_name))
        else:
            for by_row, by_col in levels:
                keys = (marks if by_row else []) + (["__head"] if by_col else [])
                cells = group_agg(tagged, keys, {"__v": (value, agg)}, order_by, label)
                parts.append(
                    cells.select(
                        *[(quoted(m) if by_row else t).alias(m) for m, t in zip(marks, total_row)],
                        (F.col("__head") if by_col else F.lit(margins_name)).alias("__head"),
                        F.col("__v"),
                    )
                )
        long = stacked(parts)
    else:
        marks, headings = rows, heads
        long = group_agg(tagged, marks + ["__head"], {"__v": (value, agg)}, order_by, label, accuracy=accuracy)
    wide = long.groupBy(*[quoted(m) for m in marks]).pivot("__head", headings).agg(F.first("__v"))
    wide = wide.toDF(*rows, *headings)
    if not keep_all_null_columns:
        empty = drop_missing_columns(wide.select(*[quoted(h) for h in headings]), "all").columns
        wide = wide.select(*[quoted(r) for r in rows], *[quoted(h) for h in headings if h in empty])
    changed = {}
    for h in wide.columns[len(rows):]:
        c = quoted(h)
        if fill_value is not None:
            c = F.coalesce(c, F.lit(fill_value))
        if precision is not None and isinstance(dtype(wide, h), T.NumericType):
            c = F.round(c, precision)
        changed[h] = c
    return wide.withColumns(changed) if changed else wide


def _medians_with_margins(tagged: DataFrame, marks: list[str], total_row: list, levels: list[tuple[bool, bool]], value: str, margins_name: str) -> DataFrame:
    """Medians of cells and margins out of one count of the values, which the margins add up."""
    heading = [*marks, "__head"]
    counts = tagged.groupBy(*[quoted(m) for m in heading], clean(tagged, value).cast("double").alias("__w")).agg(F.count(clean(tagged, value)).alias("__n"))
    places = [
        F.struct(*[(quoted(m) if by_row else t).alias(m) for m, t in zip(marks, total_row)], (F.col("__head") if by_col else F.lit(margins_name)).alias("__head"))
        for by_row, by_col in levels
    ]
    each = counts.select(F.col("__w"), "__n", F.explode(F.array(*places)).alias("__p")).select("__p.*", "__w", "__n")
    if few_values(tagged, [value]):
        return each.groupBy(*[quoted(m) for m in heading]).agg(F.percentile("__w", F.lit(0.5), F.col("__n")).alias("__v"))
    added = settled(each.groupBy(*[quoted(m) for m in heading], "__w").agg(F.sum("__n").alias("__n")))
    found = quantiles_of_counts(added, heading, "__w", "__n", {"__v": [0.5]})
    return found.select(*[quoted(m) for m in heading], F.get("__v", F.lit(0)).alias("__v"))


def pivot_wide(df: DataFrame, variable: str, value: str, values: Sequence | None = None, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Long to wide: one column per value of ``variable``; the other columns identify the row.

    Two values for the same cell are an error.
    """
    need_columns(df, [variable, value])
    rest = [c for c in df.columns if c not in (variable, value)]
    if not rest:
        raise ValueError("long to wide needs at least one column besides variable and value")
    if values is None:
        values = [v[0] for v in distinct_values(df.where(quoted(variable).isNotNull()), [variable], max_columns, "long to wide")]
    clashing = F.raise_error(F.lit("long to wide: several values for the same cell"))
    cells = df.groupBy(*[quoted(c) for c in rest], quoted(variable)).agg(
        F.when(F.count(F.lit(1)) > 1, clashing.cast(dtype(df, value))).otherwise(F.first(quoted(value))).alias("__cell")
    )
    wide = cells.groupBy(*[quoted(c) for c in rest]).pivot(variable, list(values)).agg(F.first("__cell"))
    return wide.toDF(*rest, *[str(v) for v in values])


def melt(df: DataFrame, id_columns, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long: every other column becomes a (variable, value) row of the common type."""
    ids = resolve(df, id_columns)
    rest = [c for c in df.columns if c not in ids]
    if not rest:
        raise ValueError("nothing to melt: all columns identify the row")
    kind = common_type([dtype(df, c) for c in rest])
    even = df.select(*[quoted(c) for c in ids], *[quoted(c).cast(kind).alias(c) for c in rest])
    return even.unpivot([quoted(c) for c in ids], [quoted(c) for c in rest], variable, value)


def explode_rows(df: DataFrame, column: str) -> DataFrame:
    """One row per list item; an empty or missing list gives one row with a missing item."""
    need_columns(df, [column])
    return df.select(*[F.explode_outer(quoted(c)).alias(c) if c == column else quoted(c) for c in df.columns])
