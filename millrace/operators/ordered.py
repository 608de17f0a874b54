"""Running calculations over an ordered table without one-task windows.

A plain window sends a whole group (or the whole table, without groups) to one task. Here the rows
are cut into *slices*: consecutive ranges of the (group, order) key. Each slice is one window
partition, so a hot group is spread over many tasks, and what earlier slices contribute is added
from a small table of slice totals.

The cut points are literal values found by one sampling pass, so the slice of a row depends on the
row alone: a retried or recomputed task always puts it in the same slice. A group can only cross a
slice border if it owns the cut point there, so the totals table has at most two rows per slice and
may be broadcast.

Cut points hold at most ``CUT_LENGTH`` characters of a text. Where so many rows share these characters
that cut points repeat, what all of them share is skipped and the rows are cut by the characters after it,
as in the inner nodes of a search tree, level by level. Group keys only have to be kept apart, so long
ones are cut by their digest.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from millrace.contract import all_true, dtype, need_columns, need_order, quoted
from millrace.session import settled

ROWS_PER_SLICE_KEY = "millrace.rowsPerSlice"
ROWS_PER_SLICE = 100_000
#: More cut points than this would make plans too long; a setting for larger tables.
MAX_SLICES_KEY = "millrace.maxSlices"
MAX_SLICES = 10_000
SAMPLED_PER_SLICE = 20
#: Characters of an order text that one level of cut points looks at, and of a group key before its digest.
CUT_LENGTH = 128
SEED = 123

SLICE = "__slice"
TIE = "__tie"


@dataclass(frozen=True)
class Sliced:
    """A table whose rows carry their slice number."""

    df: DataFrame
    by: list[str]
    order_by: list[str]
    columns: list[str] = field(default_factory=list)
    owners: DataFrame | None = None  # groups that own a cut point; None means a single slice

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE, TIE)


@dataclass(frozen=True)
class Measure:
    """One running value: ``kind`` is sum, count, product, last or total."""

    out: str
    kind: str
    value: Column
    exclusive: bool = False


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_SLICE_KEY, str(ROWS_PER_SLICE)))


def _sortable(df: DataFrame, name: str) -> Column:
    """The column as a type that survives a round trip through the driver unchanged."""
    kind, c = dtype(df, name), quoted(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c


def _parts(df: DataFrame, names: Sequence[str], stem: str, values: Sequence[Column] | None = None) -> list[Column]:
    """(missing flag, value) per column; ``values`` replace the columns' own."""
    parts = []
    for i, name in enumerate(names):
        # no ELSE branch: nullable like the constants it is compared with, which spares a cast per row
        flag = F.when(quoted(name).isNull(), 1).when(quoted(name).isNotNull(), 0)
        parts.append(flag.alias(f"{stem}{i}n"))
        parts.append((_sortable(df, name) if values is None else values[i]).alias(f"{stem}{i}v"))
    return parts


def sort_parts(df: DataFrame, names: Sequence[str], stem: str) -> list[Column]:
    """The columns as a key whose order is that of a sort, missing values last."""
    return _parts(df, names, stem)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.StringType, T.BinaryType))


def _groups(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """The group columns as short values that keep groups apart; they need not sort like the columns."""
    out = []
    for name in by:
        value = _sortable(df, name)
        if _is_text(df, name):
            long = F.concat(F.substring(value, 1, CUT_LENGTH), F.sha2(value.cast("binary"), 256))
            value = F.when(F.length(value) > CUT_LENGTH, long).otherwise(value)
        out.append(value)
    return out


def _order(df: DataFrame, names: Sequence[str], skipped: Sequence[Column | int]) -> list[Column]:
    """(missing flag, value) per order column, texts as their next characters after those skipped.

    What follows a text that may go on is left out: rows that differ there are told apart one level below.
    """
    parts, ended = [], None
    for i, (name, k) in enumerate(zip(names, skipped)):
        flag = F.when(quoted(name).isNull(), 1).when(quoted(name).isNotNull(), 0)
        value = _sortable(df, name)
        text = _is_text(df, name)
        if text:
            value = F.substring(value, k + 1, CUT_LENGTH)
        if ended is not None:
            flag, value = F.when(ended, flag), F.when(ended, value)
        parts += [flag.alias(f"o{i}n"), value.alias(f"o{i}v")]
        if text:
            short = F.coalesce(F.length(value) < CUT_LENGTH, F.lit(True))
            ended = short if ended is None else ended & short
    return parts


def _sort(names: Sequence[str], reverse: bool) -> list[Column]:
    return [quoted(n).desc_nulls_first() if reverse else quoted(n).asc_nulls_last() for n in names]


def _constant(value, kind: T.DataType) -> Column:
    """A nested constant; folded once when the plan is optimised."""

    def plain(v):
        if isinstance(v, Row):
            return {k: plain(x) for k, x in v.asDict().items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    text = json.dumps(plain(value), default=str)
    wrapped = F.from_json(F.lit('{"c":' + text + "}"), T.StructType([T.StructField("c", kind)]))
    return wrapped.getField("c")


@dataclass
class _Node:
    """Cut points of rows that are equal in all characters skipped; the rows at some of them are cut further."""

    cuts: list[Row]
    skipped: list[int]
    further: dict[int, _Node] = field(default_factory=dict)

    def slices(self) -> int:
        return len(self.cuts) + 1 + sum(n.slices() for n in self.further.values())


def _shared(a: Column, b: Column) -> Column:
    """How many first characters two texts share."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    grow = lambda n, step: F.when((n + step <= most) & (F.substring(a, 1, n + step) == F.substring(b, 1, n + step)), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), grow)


def _let(value: Column, inside) -> Column:
    """``inside(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), inside), 0)


def _located(df: DataFrame, by: Sequence[str], order_by: Sequence[str], levels: list[list[_Node]], kinds: list[T.DataType]) -> DataFrame:
    """Adds the slice and ``__at``: the place among ``levels[-1]``'s cut points of rows that equal one of them, else missing.

    A level holds the nodes below the one before, in order. The search is a single expression: a chain of
    columns that use each other several times would be written out anew in every filter pushed below them.
    """
    numbers = lambda values: F.array(*[F.lit(v).cast("int") for v in values])

    def below(level: int, node: Column, passed: Column) -> Column:
        nodes, kind = levels[level], kinds[level]
        own = lambda values: F.get(numbers(values), node) if len(nodes) > 1 else F.lit(values[0])
        size, start = own([len(n.cuts) for n in nodes]), own([sum(len(n.cuts) for n in nodes[:i]) for i in range(len(nodes))])
        order = _order(df, order_by, [own([n.skipped[i] for n in nodes]) if level else 0 for i in range(len(order_by))])
        whole = F.struct(*order) if level else F.struct(*_parts(df, by, "b", _groups(df, by)), *order)
        cuts = _constant([c for n in nodes for c in n.cuts], T.ArrayType(kind))
        steps = numbers([1 << k for k in range(max(len(n.cuts) for n in nodes).bit_length(), -1, -1)])
        # slices before a place, those that its own rows take up if they are cut further, and the node they go to
        before, inside, further = [], [], []
        for n in nodes:
            passed_by = 0
            before.append(0)
            inside.append(0)
            for i in range(len(n.cuts)):
                before.append(i + 1 + passed_by)
                inside.append(n.further[i].slices() if i in n.further else 0)
                passed_by += inside[-1]
                further.append(sum(x is not None for x in further) if i in n.further else None)

        def searched(key: Column) -> Column:
            # a binary search: the number of cut points that are not above the key
            step = lambda at, k: at + F.when((at + k <= size) & (F.get(cuts, start + at + k - 1) <= key), k).otherwise(0)
            return _let(F.aggregate(steps, F.lit(0), step), lambda found: placed(key, found))

        def placed(key: Column, found: Column) -> Column:
            at = F.when((found > 0) & (F.get(cuts, start + found - 1) == key), start + found - 1)
            place = start + own(list(range(len(nodes)))) + found  # each node has one place more than cut points
            number = passed + F.get(numbers(before), place)
            if level + 1 == len(levels):
                return F.struct(number.alias("slice"), at.alias("at"))
            behind = F.struct((number + F.get(numbers(inside), place)).alias("slice"), F.lit(None).cast("int").alias("at"))
            return _let(F.get(numbers(further), at), lambda child: F.when(child.isNull(), behind).otherwise(below(level + 1, child, number)))

        return _let(whole, searched)

    out = df.withColumn("__found", below(0, F.lit(0), F.lit(0)))
    return out.withColumn(SLICE, F.coalesce(F.col("__found.slice"), F.lit(0))).withColumn("__at", F.col("__found.at")).drop("__found")


def _cut_further(df: DataFrame, by: Sequence[str], order_by: Sequence[str], levels: list[list[_Node]], kinds: list[T.DataType], runs: dict[int, tuple[int, int]], fraction: float) -> None:
    """Add a level below the cut points in ``runs``: place to (times drawn, the order column that goes on)."""
    places = sorted(runs)
    rows = _located(df, by, order_by, levels, kinds)
    going_on = F.coalesce(*[F.when(F.col("__at").isin([p for p in places if runs[p][1] == i]), _sortable(df, order_by[i])) for i in {runs[p][1] for p in places}])
    wanted = F.when(F.col("__at").isin(places), F.col("__at")).alias("at")
    ends = rows.select(wanted, going_on.alias("text")).groupBy("at").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    # what all rows there share; where the text is the same in all of them, it is passed as a whole
    shared = {r["at"]: r["n"] for r in ends.select("at", _shared(F.col("lo"), F.col("hi")).alias("n")).collect()}  # one row per cut point
    owner = [(n, i) for n in levels[-1] for i in range(len(n.cuts))]
    below = []
    for p in places:
        node, i = owner[p]
        skipped = list(node.skipped)
        skipped[runs[p][1]] = shared[p]
        below.append(_Node([], skipped))
        node.further[i] = below[-1]
    drawn = rows.withColumn("__child", F.create_map(*[F.lit(v) for pair in zip(places, range(len(places))) for v in pair])[F.col("__at")])
    skips = [F.get(F.array(*[F.lit(n.skipped[i]) for n in below]), F.col("__child")) for i in range(len(order_by))]
    key = F.struct(*_order(df, order_by, skips))
    inside = drawn.select("__child", F.when(F.col("__child").isNotNull(), key).alias("k")).sample(False, fraction, SEED)
    keys = inside.groupBy("__child").agg(F.array_sort(F.collect_list("k")).alias("k"))
    kinds.append(keys.schema["k"].dataType.elementType)
    for r in keys.collect():  # about 20 short keys per slice
        if r["__child"] is None:
            continue
        have, pieces = r["k"], runs[places[r["__child"]]][0] + 1
        below[r["__child"]].cuts = [have[i * len(have) // pieces] for i in range(1, pieces)]
    levels.append(below)


def _repeated(df: DataFrame, order_by: Sequence[str], nodes: list[_Node]) -> tuple[dict[int, tuple[int, int]], bool]:
    """Folds cut points drawn several times into one: their places, how often and the text column that goes on; and whether some have none."""
    runs, tied, place = {}, False, 0
    texts = [i for i, name in enumerate(order_by) if _is_text(df, name)]
    for n in nodes:
        drawn = Counter(n.cuts)
        for c, times in drawn.items():
            if times > 1:
                going_on = next((i for i in texts if len(c[f"o{i}v"] or "") >= CUT_LENGTH), None)
                if going_on is None:
                    tied = True
                else:
                    runs[place] = (times, going_on)
            place += 1
        n.cuts = list(drawn)
    return runs, tied


def slice_rows(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    rows: int | None = None,
    drawn_from: DataFrame | None = None,
) -> Sliced:
    """Cut the table along (by, order_by); one slice if it is known to be small.

    ``rows`` is the row count, if known. A table without ties may name a cheaper table with the same
    columns to draw the cut points from, such as the rows it was aggregated from.
    """
    order_by = need_order(df, order_by, "a running calculation")
    by = need_columns(df, by)
    columns = df.columns
    size = rows_per_slice(df)
    total = df.count() if rows is None else rows
    if total <= size:
        return Sliced(df.withColumn(SLICE, F.lit(0)), list(by), order_by, columns)

    spark = df.sparkSession
    wanted = min(int(spark.conf.get(MAX_SLICES_KEY, str(MAX_SLICES))), math.ceil(total / size))
    source = df if drawn_from is None else drawn_from
    fraction = min(1.0, 1.2 * SAMPLED_PER_SLICE * wanted / total)
    # about 20 sampled keys per slice, whatever the size of the table
    key = F.struct(*_parts(source, by, "b", _groups(source, by)), *_order(source, order_by, [0] * len(order_by)))
    sampled = source.select(key.alias("k")).sample(False, fraction, SEED).agg(F.array_sort(F.collect_list("k")).alias("k"))
    cuts = sampled.select(
        F.transform(
            F.sequence(F.lit(1), F.lit(wanted - 1)),
            lambda i: F.get(F.col("k"), F.floor(i * F.size("k") / wanted).cast("int")),
        ).alias("cuts")
    )
    levels = [[_Node([c for c in cuts.first()["cuts"] if c is not None], [0] * len(order_by))]]
    kinds = [cuts.schema["cuts"].dataType.elementType]
    runs, tied = _repeated(source, order_by, levels[0])
    root = levels[0][0]
    if not root.cuts:
        return Sliced(df.withColumn(SLICE, F.lit(0)), list(by), order_by, columns)
    while runs:
        _cut_further(source, by, order_by, levels, kinds, runs, fraction)
        runs, equal = _repeated(source, order_by, levels[-1])
        tied |= equal
    if tied and drawn_from is None and TIE not in df.columns:
        # one position holds more rows than a slice: break its ties by a random number, written
        # once so that every pass and every retried task sees the same one
        return slice_rows(settled(df.withColumn(TIE, F.rand(SEED))), by, [*order_by, TIE], total)
    cut = _located(df, by, order_by, levels, kinds).drop("__at")

    if by:
        fields = [f for f in kinds[0].fields if f.name.startswith("b")]
        values = {tuple(c[f.name] for f in fields) for c in root.cuts}
        owners = spark.createDataFrame(list(values), T.StructType([T.StructField(f"__{f.name}", f.dataType) for f in fields]))
    else:
        owners = spark.createDataFrame([(1,)], "one int")
    return Sliced(cut, list(by), order_by, columns, owners)


def _local(m: Measure, window, whole) -> Column:
    if m.kind == "total":
        return F.sum(m.value).over(whole)
    if m.kind == "sum":
        return F.sum(m.value).over(window)
    if m.kind == "count":
        return F.count(m.value).over(window)
    if m.kind == "product":
        return F.product(m.value).over(window)
    if m.kind == "last":
        return F.last(m.value, ignorenulls=True).over(window)
    raise ValueError(f"unknown running kind {m.kind!r}")


def _total(m: Measure, key: Column, reverse: bool) -> Column:
    if m.kind in ("sum", "total"):
        return F.sum(m.value)
    if m.kind == "count":
        return F.count(m.value)
    if m.kind == "product":
        return F.product(m.value)
    pick = F.min_by if reverse else F.max_by
    return pick(m.value, F.when(m.value.isNotNull(), key))


def _carry(m: Measure, before, everything) -> Column:
    c = F.col(f"__t_{m.out}")
    if m.kind == "total":
        return F.sum(c).over(everything)
    if m.kind in ("sum", "count"):
        return F.sum(c).over(before)
    if m.kind == "product":
        return F.product(c).over(before)
    return F.last(c, ignorenulls=True).over(before)


def _combine(m: Measure) -> Column:
    local, carried = F.col(f"__l_{m.out}"), F.col(f"__c_{m.out}")
    if m.kind == "sum":
        return F.coalesce(local + carried, local, carried)
    if m.kind == "count":
        return local + F.coalesce(carried, F.lit(0))
    if m.kind == "product":
        return F.coalesce(local * carried, local, carried)
    if m.kind == "total":
        return F.coalesce(carried, local)
    return F.coalesce(local, carried)


def running(sliced: Sliced, measures: Sequence[Measure], reverse: bool = False) -> Sliced:
    """Add running values; ``reverse`` runs from the last row to the first."""
    df, by = sliced.df, sliced.by
    groups = [quoted(b) for b in by]
    frame = Window.partitionBy(F.col(SLICE), *groups).orderBy(*_sort(sliced.order_by, reverse))
    upto = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = frame.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.col(SLICE), *groups)
    locals_ = df.select(
        "*", *[_local(m, before if m.exclusive else upto, whole).alias(f"__l_{m.out}") for m in measures]
    )
    kept = [quoted(c) for c in df.columns if c not in {m.out for m in measures}]
    if sliced.owners is None:
        out = locals_.select(*kept, *[F.col(f"__l_{m.out}").alias(m.out) for m in measures])
        return replace(sliced, df=out, columns=[c for c in out.columns if c != SLICE])

    key = F.struct(*_parts(df, sliced.order_by, "o"))
    narrow = df.select(
        F.col(SLICE),
        *groups,
        *_parts(df, by, "__b", _groups(df, by)),
        key.alias("__key"),
        *[m.value.alias(f"__v_{m.out}") for m in measures],
    )
    if by:
        # only groups that own a cut point can span slices: at most one per cut
        names = [f"__b{i}{p}" for i in range(len(by)) for p in ("n", "v")]
        owners = F.broadcast(sliced.owners.toDF(*[f"__own{n}" for n in names]))
        narrow = narrow.join(owners, all_true([F.col(n).eqNullSafe(F.col(f"__own{n}")) for n in names]), "left_semi")
    totals = narrow.groupBy(F.col(SLICE), *groups).agg(
        *[
            _total(replace(m, value=F.col(f"__v_{m.out}")), F.col("__key"), reverse).alias(f"__t_{m.out}")
            for m in measures
        ]
    )
    order = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
    whole_group = Window.partitionBy(*groups)
    earlier = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        F.col(SLICE).alias("__s"),
        *[g.alias(f"__g{i}") for i, g in enumerate(groups)],
        *[_carry(m, earlier, whole_group).alias(f"__c_{m.out}") for m in measures],
    )
    on = all_true(
        [F.col(SLICE) == F.col("__s")] + [g.eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    )
    out = locals_.join(F.broadcast(carries), on, "left").select(*kept, *[_combine(m).alias(m.out) for m in measures])
    return replace(sliced, df=out, columns=[c for c in out.columns if c != SLICE])


def number_rows(df: DataFrame, order_by: Sequence[str], out: str, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """Consecutive row numbers in the given order."""
    sliced = running(slice_rows(df, by, order_by), [Measure(out, "count", F.lit(1))])
    return sliced.rows().withColumn(out, F.col(out) + F.lit(start - 1))
