"""Predictive power: how much a single column tells about another one.

The model of a pair (x, y) is a regression or classification tree of the one column x, grown until a
leaf holds a single value of x: it predicts the mean (or the most frequent, least first) y of the
training rows with the same x, and for numbers it has not seen, that of the nearest x (the lower one of
equals). Four folds are each predicted from the other three. A score is the share of the error of the
best guess without x that the model removes: 0 is no better than that guess, 1 is perfect.

The rows of a feature are cut into slices along its values, so that each slice holds whole leaves and a task
works out all targets of its leaves at once (``leaves.py``); no table of pairs of values is made. Leaves with more
rows than half a slice, found in a bounded sample, are sums over all rows instead, and their errors another sum.
Guesses of the nearest numbers in other slices follow from the first and last guess of each slice. Case, baseline
and guesses for whole columns come from one count of the values of each column (and, where another one has
missing values, of the rows where that is known). The number of classes and of distinct values is not limited; a
result has one row per pair of columns.

Numbers and times are compared as double precision numbers, whole numbers above 2^53 thus by their
nearest one. Rows where x or y is missing do not count for the pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.contract import DATETIMES, clean, dtype, need_batch, need_columns
from millrace.operators.ordered import MAX_SLICES, MAX_SLICES_KEY, SAMPLED_PER_SLICE, Measure, rows_per_slice, running, slice_rows
from millrace.plans.leaves import FOLDS, SCHEMA, slice_work
from millrace.session import settled

SEED = 123
#: A pair needs this many rows.
LEAST_ROWS = 2 * FOLDS
PAIR = ["__f", "__t"]


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, *DATETIMES))


def _parts(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The column as (number, text), one of them missing."""
    kind, c = dtype(df, name), clean(df, name)
    if isinstance(kind, DATETIMES):
        return F.unix_micros(c.cast("timestamp")).cast("double"), F.lit(None).cast("string")
    if _is_number(kind):
        return c.cast("double"), F.lit(None).cast("string")
    return F.lit(None).cast("double"), c.cast("string")


def _fold(df: DataFrame, fold_by: Sequence[str], seed: int) -> Column:
    """0 to 3; by the columns that name a row, else at random."""
    if not fold_by:
        return F.pmod(F.floor(F.rand(seed) * 1_000_000), F.lit(FOLDS)).cast("int")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in need_columns(df, fold_by)])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 1), 16, 10).cast("int") % FOLDS


def _all(stem: str) -> Column:
    return reduce(lambda a, b: a + b, (F.col(f"{stem}{k}") for k in range(FOLDS)))


def _outside(k: int) -> Column:
    """Rows outside a fold."""
    return _all("__n") - F.col(f"__n{k}")


def _guesses(cells: DataFrame, by: Sequence[str], classes: bool) -> DataFrame:
    """What each fold's rows are told by the others: ``__p0`` to ``__p3``, missing where the others have no rows."""
    told = []
    for k in range(FOLDS):
        if classes:
            best = F.min_by("__label", F.when(_outside(k) > 0, F.struct((-_outside(k)).alias("n"), "__label")))
        else:
            outside = F.sum(_outside(k))
            best = F.when(outside > 0, F.sum(F.col("__yn") * _outside(k)) / outside)
        told.append(best.alias(f"__p{k}"))
    return cells.groupBy(*by).agg(*told)


def _columns(df: DataFrame, names: Sequence[str], fold: Column) -> DataFrame:
    """The fold ``k`` and the columns as numbers or texts ``c0``, ``c1`` and so on."""
    return df.select(fold.alias("k"), *[_parts(df, n)[0 if _is_number(dtype(df, n)) else 1].alias(f"c{i}") for i, n in enumerate(names)])


def _pairs(df: DataFrame, xs: Sequence[str], ys: Sequence[str], partial: Sequence[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Maps (feature, target) to the columns that must be known for the target's and for the feature's values to count; -1 if all are."""
    names = list(dict.fromkeys([*xs, *ys]))
    given = lambda i: i if i in partial else -1
    return {(f, t): (given(f), given(t)) for f in map(names.index, xs) for t in map(names.index, ys) if f != t}


def _cells(df: DataFrame, xs: Sequence[str], ys: Sequence[str], fold: Column, partial: Sequence[int] = (), base: DataFrame | None = None) -> DataFrame:
    """How many rows of each fold have which value of a column ``__t``, of those where column ``__f`` (if not -1) is known.

    ``partial`` lists the columns with missing values, ``base`` are the ``_columns`` if they exist already.
    """
    names = list(dict.fromkeys([*xs, *ys]))
    number = [_is_number(dtype(df, n)) for n in names]
    base = _columns(df, names, fold) if base is None else base
    given: dict[int, set[int]] = {}
    for (f, t), (for_y, for_x) in _pairs(df, xs, ys, partial).items():
        given.setdefault(t, set()).add(for_y)
        if not number[f]:
            given.setdefault(f, set()).add(for_x)
    places, partial = sorted(given), sorted({g for of in given.values() for g in of if g >= 0})
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("t"), (F.col(f"c{i}") if number[i] else F.lit(None).cast("double")).alias("n"), (F.lit(None).cast("string") if number[i] else F.col(f"c{i}")).alias("text"),
            F.array(*[F.lit(g) for g in sorted(given[i])]).alias("given"),
        )
        for i in places
    ])
    there = F.array_compact(F.array(F.lit(-1), *[F.when(F.col(f"c{i}").isNotNull(), F.lit(i)) for i in partial]))
    rows = base.select("k", there.alias("there"), F.explode(entries).alias("e")).where(F.col("e.n").isNotNull() | F.col("e.text").isNotNull())
    rows = rows.select("k", F.explode(F.array_intersect("e.given", "there") if partial else F.col("e.given")).alias("__f"), F.col("e.t").alias("__t"), F.col("e.n").alias("__yn"), F.col("e.text").alias("__yt"))
    return rows.groupBy(*PAIR, "__yn", "__yt").agg(*[F.count_if(F.col("k") == k).alias(f"__n{k}") for k in range(FOLDS)])


def _label() -> Column:
    return F.coalesce("__yt", F.col("__yn").cast("string"))


def _medians_error(counts: DataFrame) -> DataFrame:
    """The mean distance of each column's values from their median."""
    counts = counts.select(*PAIR, "__yn", _all("__n").alias("__n"))
    ranked = running(slice_rows(counts, PAIR, ["__yn"]), [Measure("__upto", "sum", F.col("__n")), Measure("__rows", "total", F.col("__n"))]).rows()
    middle = (F.col("__rows") - 1) / 2
    holds = lambda rank: F.max(F.when((F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto")), F.col("__yn")))
    medians = ranked.groupBy(*PAIR).agg(((holds(F.floor(middle)) + holds(F.ceil(middle))) / 2).alias("__median"))
    # one row per column (and column with missing values)
    apart = counts.join(F.broadcast(medians), PAIR).groupBy(*PAIR)
    return apart.agg((F.sum(F.col("__n") * F.abs(F.col("__yn") - F.col("__median"))) / F.sum("__n")).alias("baseline"))


def _cases(counts: DataFrame, pairs: dict, number: dict[int, bool]) -> dict[tuple[int, int], str]:
    """``pairs`` maps (feature, target) to the columns given for the target's and for the feature's values."""
    rows = counts.groupBy(*PAIR).agg(F.sum(_all("__n")).alias("rows"), F.count(F.lit(1)).alias("values"))
    seen = {(r["__f"], r["__t"]): (r["rows"], r["values"]) for r in rows.collect()}  # one row per column (and column with missing values)
    out = {}
    for (f, t), (for_y, for_x) in pairs.items():
        n, ys = seen.get((for_y, t), (0, 0))
        if n < LEAST_ROWS:
            out[f, t] = "too_few_rows"
        elif ys == 1:
            out[f, t] = "target_is_constant"
        elif not number[f] and seen[for_x, f][1] >= n:
            out[f, t] = "feature_is_id"
        elif not number[t] and ys >= n:
            out[f, t] = "target_is_id"
        else:
            out[f, t] = "regression" if number[t] and ys > 2 else "classification"
    return out


class _Trees:
    """Errors and hits of the models of all pairs."""

    def __init__(self, base: DataFrame, known: dict[int, int], number: dict[int, bool], numbers: dict[int, list[int]], classes: dict[int, list[int]], whole: dict):
        self.base, self.known, self.number, self.numbers, self.classes, self.whole = base, known, number, numbers, classes, whole
        self.spark = base.sparkSession
        self.features = sorted({*numbers, *classes})
        self.ys, self.labels = (sorted({t for ts in of.values() for t in ts}) for of in (numbers, classes))

    def rows(self) -> DataFrame:
        """One row per row and feature known there, with all targets. Long texts of features are digests."""
        entries = []
        for i in self.features:
            c = F.col(f"c{i}")
            text = F.when(F.length(c) > 64, F.sha2(c.cast("binary"), 256)).otherwise(F.concat(F.lit("="), c))
            none = F.lit(None)
            entries.append(F.struct(F.lit(i).alias("f"), (c if self.number[i] else none.cast("double")).alias("xn"), (none.cast("string") if self.number[i] else text).alias("xt")))
        targets = [F.col(f"c{t}").alias(f"y{t}") for t in self.ys] + [F.col(f"c{t}").cast("string").alias(f"l{t}") for t in self.labels]
        long = self.base.select("k", *targets, F.explode(F.array(*entries)).alias("e")).where(F.col("e.xn").isNotNull() | F.col("e.xt").isNotNull())
        return long.select("e.f", "e.xn", "e.xt", "k", *[f"y{t}" for t in self.ys], *[f"l{t}" for t in self.labels])

    def sums(self) -> tuple[DataFrame, DataFrame]:
        """(f, t, k, err, n) and (f, t, k, c, own, said, hit)."""
        long, size = self.rows(), rows_per_slice(self.base)
        total = sum(self.known[f] for f in self.features)
        most = int(self.spark.conf.get(MAX_SLICES_KEY, str(MAX_SLICES)))
        wanted, found, hot_share = min(most, math.ceil(total / size)), [], 0.0
        if wanted > 1:
            drawn = long.select("f", "xn", "xt").sample(False, min(1.0, SAMPLED_PER_SLICE * wanted / total), SEED)
            leaves = drawn.groupBy("f", "xn", "xt").count().withColumn("often", F.col("count") >= SAMPLED_PER_SLICE // 2).groupBy("often")
            # leaves of more than about half a slice: at most two per slice
            for r in leaves.agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("often"), F.struct("f", "xn", "xt"))).alias("at")).collect():
                found, hot_share = ([tuple(x) for x in r["at"]], r["n"]) if r["often"] else (found, hot_share)
            hot_share /= max(1, min(total, SAMPLED_PER_SLICE * wanted))
        marks = [(i, *leaf) for i, leaf in enumerate(sorted(found, key=str))]
        hot = self.spark.createDataFrame(marks, "h int, f int, xn double, xt string")
        if marks:
            here = F.broadcast(hot.toDF("h", "hf", "hn", "ht"))
            on = (F.col("f") == F.col("hf")) & F.col("xn").eqNullSafe(F.col("hn")) & F.col("xt").eqNullSafe(F.col("ht"))
            tagged = long.join(here, on, "left").drop("hf", "hn", "ht")
        else:
            tagged = long.withColumn("h", F.lit(None).cast("int"))
        self.feature_of = {h: f for h, f, *_ in marks}
        large = tagged.where(F.col("h").isNotNull())
        told, cells = self._hot_guesses(large) if marks else ({}, None)
        work = slice_work(self.number, self.numbers, self.classes, self.whole, told)
        cold = tagged.where(F.col("h").isNull()).unionByName(hot.where(F.col("xn").isNotNull()).withColumn("k", F.lit(0)), allowMissingColumns=True)
        per_task = 4 * size // max(1, len(self.ys) // 8, len(self.labels) // 8)
        tasks = max(1, math.ceil(total * max(0.0, 1 - hot_share) / max(1, per_task)))
        out = settled(cold.repartitionByRange(tasks, "f", "xn", "xt").mapInArrow(work, SCHEMA))
        opened = self._resolved(out)
        lacking = [(h, t) for (h, t), (_, need) in told.items() if any(need) and self.number[self.feature_of[h]]]
        if lacking:
            # a few per leaf of many rows
            for r in opened.where(F.col("h").isNotNull()).select("h", "t", "k", "p", "guess").collect():
                told[r["h"], r["t"]][0][r["k"]] = r["p"] if r["p"] is not None else r["guess"]
        for (h, t), (guesses, _) in told.items():
            if not self.number[f := self.feature_of[h]]:
                guesses[:] = [self.whole[f, t][k] if g is None else g for k, g in enumerate(guesses)]
        sums, opened = out.where(F.col("kind") == "sum"), opened.where(F.col("h").isNull())
        errors = [sums.where(F.col("err").isNotNull()).select("f", "t", "k", "err", "n"), opened.where(F.col("p").isNotNull()).select("f", "t", "k", (F.abs(F.col("y") - F.col("p")) * F.col("n")).alias("err"), "n")]
        hits = [sums.where(F.col("c").isNotNull()).select("f", "t", "k", "c", "own", "said", "hit"), self._hits(opened.where(F.col("guess").isNotNull()).select("f", "t", F.struct("k", "c", "guess", "n").alias("e")))]
        if marks:
            more = self._hot_errors(large, cells, told)
            errors.append(more[0])
            hits.append(more[1])
        errors = reduce(DataFrame.unionByName, errors).groupBy("f", "t", "k").agg(F.sum("err").alias("err"), F.sum("n").alias("n"))
        hits = reduce(DataFrame.unionByName, hits).groupBy("f", "t", "k", "c").agg(*[F.sum(c).alias(c) for c in ("own", "said", "hit")])
        return errors, hits

    def _hits(self, rows: DataFrame) -> DataFrame:
        """``rows`` have (k, c, guess, n) in e."""
        e, none = F.col("e"), F.lit(0).cast("long")
        right = F.when(e["c"] == e["guess"], e["n"]).otherwise(none)
        own = F.struct(e["c"].alias("c"), e["n"].alias("own"), none.alias("said"), right.alias("hit"))
        said = F.struct(e["guess"].alias("c"), none.alias("own"), e["n"].alias("said"), none.alias("hit"))
        return rows.select("f", "t", e["k"].alias("k"), F.inline(F.array(own, said)))

    def _hot_guesses(self, large: DataFrame) -> tuple[dict, DataFrame]:
        """By (leaf, target) the guesses of the folds and where one is needed but missing; and the counts of labels."""
        told = {}
        if self.ys:
            known = [x for t in self.ys for x in (F.sum(f"y{t}"), F.count(f"y{t}"))]
            # one row per leaf of many rows, and fold
            found = {(r[0], r[1]): r[2:] for r in large.groupBy("h", "k").agg(*known).collect()}
            for h, f in self.feature_of.items():
                for t in self.numbers.get(f, ()):
                    j = 2 * self.ys.index(t)
                    parts = [found[h, k][j : j + 2] if (h, k) in found else (None, 0) for k in range(FOLDS)]
                    rows = [sum(n for i, (_, n) in enumerate(parts) if i != k) for k in range(FOLDS)]
                    told[h, t] = [math.fsum(s for i, (s, n) in enumerate(parts) if i != k and n) / rows[k] if rows[k] else None for k in range(FOLDS)], [n > 0 and not rows[k] for k, (_, n) in enumerate(parts)]
        cells = None
        if self.labels:
            wanted = F.create_map(*[x for f in self.features for x in (F.lit(f), F.array(*[F.lit(t) for t in self.classes.get(f, [-1])]))])
            entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"l{t}").alias("__label")) for t in self.labels])
            rows = large.select("f", "h", "k", F.inline(entries)).where(F.col("__label").isNotNull() & F.array_contains(wanted[F.col("f")], F.col("t")))
            cells = settled(rows.groupBy("f", "h", "t", "__label").agg(*[F.count_if(F.col("k") == k).alias(f"__n{k}") for k in range(FOLDS)]))
            there = [F.sum(f"__n{k}").alias(f"__r{k}") for k in range(FOLDS)]
            best = _guesses(cells, ["h", "t"], True).join(cells.groupBy("h", "t").agg(*there), ["h", "t"])
            for r in best.collect():  # one row per leaf of many rows, and target
                guesses = [r[f"__p{k}"] for k in range(FOLDS)]
                told[r["h"], r["t"]] = guesses, [r[f"__r{k}"] > 0 and guesses[k] is None for k in range(FOLDS)]
            for h, f in self.feature_of.items():
                for t in self.classes.get(f, ()):
                    told.setdefault((h, t), ([None] * FOLDS, [False] * FOLDS))
        return told, cells

    def _resolved(self, out: DataFrame) -> DataFrame:
        """Rows left open with their guesses: ``p`` of numbers, ``guess`` of classes."""
        spot, kind = ["f", "t", "k", "at"], F.col("kind")
        side = lambda s: F.when(F.col(f"{s}_x").isNotNull(), F.struct(F.col(f"{s}_x").alias("x"), F.col(f"{s}_p").alias("p"), F.col(f"{s}_c").alias("c")))
        edges = out.where(kind.isin("edge", "open")).groupBy(*spot).agg(*[F.first(F.when(kind == "edge", side(s)), True).alias(s) for s in ("lo", "hi")])
        # at most one row per slice in a window
        window = Window.partitionBy("f", "t", "k").orderBy("at")
        earlier = F.last("lo", True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        later = F.first("hi", True).over(window.rowsBetween(1, Window.unboundedFollowing))
        opened = out.where(kind == "open").select(*spot, "h", "x", "y", "c", "n", side("lo").alias("own_lo"), side("hi").alias("own_hi"))
        met = opened.join(edges.select(*spot, earlier.alias("lo"), later.alias("hi")), spot)
        lo, hi, x = F.coalesce("own_lo", "lo"), F.coalesce("own_hi", "hi"), F.col("x")
        lower = hi.isNull() | (lo.isNotNull() & (x - lo["x"] <= hi["x"] - x))
        pick = lambda name: F.when(lower, lo[name]).otherwise(hi[name])
        return met.select("f", "t", "k", "h", "x", "y", "c", "n", pick("p").alias("p"), pick("c").alias("guess"))

    def _hot_errors(self, large: DataFrame, cells: DataFrame | None, told: dict) -> tuple[DataFrame, DataFrame]:
        """``sums`` of leaves with many rows."""
        errors = self.spark.createDataFrame([], "f int, t int, k int, err double, n bigint")
        hits = self.spark.createDataFrame([], "f int, t int, k int, c string, own bigint, said bigint, hit bigint")
        if self.ys:
            rows = [(h, k, *[told[h, t][0][k] if t in self.numbers.get(f, ()) else None for t in self.ys]) for h, f in self.feature_of.items() for k in range(FOLDS)]
            guesses = self.spark.createDataFrame(rows, "h int, k int, " + ", ".join(f"p{t} double" for t in self.ys))
            apart = {t: F.abs(F.col(f"y{t}") - F.col(f"p{t}")) for t in self.ys}
            one = large.join(F.broadcast(guesses), ["h", "k"]).groupBy("f", "k").agg(*[x for t, e in apart.items() for x in (F.sum(e).alias(f"e{t}"), F.count(e).alias(f"n{t}"))])
            entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"e{t}").alias("err"), F.col(f"n{t}").alias("n")) for t in self.ys])
            errors = one.select("f", "k", F.inline(entries)).where("n > 0").select("f", "t", "k", "err", "n")
        if cells is not None:
            rows = [(h, t, *told[h, t][0]) for h, f in self.feature_of.items() for t in self.classes.get(f, ())]
            guesses = self.spark.createDataFrame(rows, "h int, t int, " + ", ".join(f"g{k} string" for k in range(FOLDS)))
            of_fold = F.array(*[F.struct(F.lit(k).alias("k"), F.col("__label").alias("c"), F.col(f"g{k}").alias("guess"), F.col(f"__n{k}").alias("n")) for k in range(FOLDS)])
            asked = cells.join(F.broadcast(guesses), ["h", "t"]).select("f", "t", F.explode(of_fold).alias("e")).where("e.n > 0 AND e.guess IS NOT NULL")
            hits = self._hits(asked)
        return errors, hits


def scores(df: DataFrame, xs: Sequence[str], ys: Sequence[str], fold_by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """One row (x, y, score, case, metric, baseline, model) for every x and y.

    ``fold_by`` names columns that tell rows apart: a row's fold then depends on them alone. Without,
    folds are drawn at random and written once with the columns.
    """
    need_batch(df, "predictive power")
    xs, ys = need_columns(df, xs), need_columns(df, ys)
    spark = df.sparkSession
    names, fold = list(dict.fromkeys([*xs, *ys])), _fold(df, fold_by, seed)
    number = {i: _is_number(dtype(df, n)) for i, n in enumerate(names)}
    base = _columns(df, names, fold)
    if not fold_by:
        base = settled(base)
    seen = base.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"c{i}").alias(f"c{i}") for i in number]).first()
    known = {i: seen[f"c{i}"] for i in number}
    partial = [i for i in number if known[i] < seen["rows"]]
    pairs = _pairs(df, xs, ys, partial)
    counts = cases = None
    if pairs:
        counts = settled(_cells(df, xs, ys, fold, partial, base))
        cases = _cases(counts, pairs, number)
    said = [(names.index(x), names.index(y), pairs.get((names.index(x), names.index(y)), (-1, -1))[0], x, y, "predict_itself" if x == y else cases[names.index(x), names.index(y)]) for x in xs for y in ys]
    asked = spark.createDataFrame(said, "f int, t int, __f int, x string, y string, case string")
    modelled = {c: [at for at, case in (cases or {}).items() if case == c] for c in ("regression", "classification")}
    of = {c: {f: [t for g, t in at if g == f] for f, _ in at} for c, at in modelled.items()}
    score_of = spark.createDataFrame([], "f int, t int, score double, metric string, baseline double, model double")
    if any(modelled.values()):
        baselines, whole = {}, {}
        for c, at in modelled.items():
            columns = sorted({(pairs[p][0], p[1]) for p in at})
            if not columns:
                continue
            chosen = counts.join(F.broadcast(spark.createDataFrame(columns, "__f int, __t int")), PAIR)
            if c == "regression":
                baselines[c] = _medians_error(chosen)
            else:
                share = F.max(_all("__n")) / F.sum(_all("__n"))
                baselines[c] = chosen.groupBy(*PAIR).agg((share * 2 * share / (1 + share)).alias("baseline"))
            if any(not number[f] for f, _ in at):
                # one row per column (and column with missing values)
                guesses = {(r["__f"], r["__t"]): [r[f"__p{k}"] for k in range(FOLDS)] for r in _guesses(chosen.withColumn("__label", _label()), PAIR, c == "classification").collect()}
                whole.update({(f, t): guesses[pairs[f, t][0], t] for f, t in at if not number[f]})
        errors, hits = _Trees(base, known, number, of["regression"], of["classification"], whole).sums()
        parts = []
        baseline, model = F.col("baseline"), F.col("model")
        for c, rows in baselines.items():
            if c == "regression":
                models = errors.groupBy("f", "t").agg(F.avg(F.col("err") / F.nullif(F.col("n"), F.lit(0))).alias("model"))
                score, metric = F.when(baseline > 0, F.greatest(F.lit(0.0), 1 - model / baseline)), "mean absolute error"
            else:
                f1 = 2 * F.col("hit") / (F.col("own") + F.col("said"))
                by_fold = hits.groupBy("f", "t", "k").agg((F.sum(F.col("own") * f1) / F.sum("own")).alias("f1"))
                models = by_fold.groupBy("f", "t").agg(F.avg("f1").alias("model"))
                score, metric = F.when(baseline < 1, F.greatest(F.lit(0.0), (model - baseline) / (1 - baseline))), "weighted F1"
            # one row per pair of columns
            at = asked.where(F.col("case") == c).select("f", "t", "__f", F.col("t").alias("__t")).distinct()
            met = at.join(F.broadcast(rows), PAIR).join(F.broadcast(models), ["f", "t"])
            parts.append(met.select("f", "t", score.alias("score"), F.lit(metric).alias("metric"), "baseline", "model"))
        score_of = reduce(DataFrame.unionByName, parts)
    fixed = F.when(F.col("case").isin("predict_itself", "target_is_constant"), 1.0).otherwise(0.0)
    return asked.join(F.broadcast(score_of), ["f", "t"], "left").select(
        "x", "y", F.coalesce(F.nanvl("score", F.lit(0.0)), fixed).alias("score"), "case", "metric", "baseline", "model")


def power_score(df: DataFrame, x: str, y: str, seed: int = SEED, fold_by: Sequence[str] = ()) -> tuple:
    """One row (x, y, score, case, metric, baseline, model)."""
    return tuple(scores(df, [x], [y], fold_by, seed).first())


def predictors(df: DataFrame, target: str, columns=None, fold_by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Every column as a predictor of the target, best first."""
    names = [c for c in (columns or df.columns) if c != target]
    return scores(df, names, [target], fold_by, seed).orderBy(F.desc("score"), "x")


def predictive_matrix(df: DataFrame, columns=None, max_columns: int = 100, fold_by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """The score of every ordered pair of columns."""
    names = list(columns or df.columns)
    if len(names) > max_columns:
        raise ValueError(f"{len(names)} columns; choose at most {max_columns}")
    return scores(df, names, names, fold_by, seed)
