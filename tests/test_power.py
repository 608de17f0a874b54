"""Predictive power against a plain tree of one column, and on mappings whose score is known."""

import hashlib
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.plans.power import power_score, predictive_matrix, predictors, scores


def fold(key) -> int:
    return int(hashlib.md5(str(key).encode()).hexdigest()[0], 16) % 4


def nearest(train: dict, x):
    if x in train:
        return train[x]
    if isinstance(x, str):
        return train[None]
    return train[min((k for k in train if k is not None), key=lambda k: (abs(k - x), k))]


def brute(rows, number: bool):
    """Baseline and model of (key, x, y) rows: four folds, each told by the others."""
    ys = [y for _, _, y in rows]
    guess = (lambda v: sum(v) / len(v)) if number else (lambda v: min(Counter(v).items(), key=lambda c: (-c[1], c[0]))[0])

    def measure(told):
        if number:
            return sum(abs(y - p) for y, p in told) / len(told)
        own, said, hit = Counter(y for y, _ in told), Counter(p for _, p in told), Counter(y for y, p in told if y == p)
        return sum(n * 2 * hit[c] / (n + said[c]) for c, n in own.items()) / len(told)

    found = []
    for k in range(4):
        train: dict = {None: [y for i, _, y in rows if fold(i) != k]}
        for i, x, y in rows:
            if fold(i) != k:
                train.setdefault(x, []).append(y)
        train = {x: guess(v) for x, v in train.items()}
        told = [(y, nearest(train, x)) for i, x, y in rows if fold(i) == k]
        if told:
            found.append(measure(told))
    best = statistics.median(ys) if number else guess(ys)
    return measure([(y, best) for y in ys]), sum(found) / len(found)


@pytest.mark.parametrize("slices", ["100000", "15"])
def test_errors_equal_a_plain_tree(spark, slices):
    spark.conf.set("millrace.rowsPerSlice", slices)
    try:
        rows = [(i, float(i * i % 37) if i % 9 else None, f"w{i * 5 % 23}" if i % 11 else None, (i * 13 % 29) / 4, "abc"[i * i % 3]) for i in range(120)]
        df = spark.createDataFrame(rows, "id int, x double, word string, y double, side string")
        got = {(r["x"], r["y"]): r for r in scores(df, ["x", "word", "y", "side"], ["y", "side"], ["id"]).collect()}
        for x, at in (("x", 1), ("word", 2), ("side", 4), ("y", 3)):
            for y, to, number in (("y", 3, True), ("side", 4, False)):
                r = got[x, y]
                if x == y:
                    assert r["case"] == "predict_itself" and r["score"] == 1
                    continue
                baseline, model = brute([(t[0], t[at], t[to]) for t in rows if t[at] is not None], number)
                assert (r["baseline"], r["model"]) == (pytest.approx(baseline), pytest.approx(model)), (x, y)
                assert r["score"] == pytest.approx(max(0, 1 - model / baseline if number else (model - baseline) / (1 - baseline)))
    finally:
        spark.conf.unset("millrace.rowsPerSlice")


@pytest.mark.parametrize("classes", [60, 150])
def test_exact_mappings_score_one(spark, classes):
    code = F.col("id") * 7 % classes
    df = spark.range(classes * 20).select("id", code.alias("x"), F.concat(F.lit("c"), code * 7919 % classes).alias("y"), (code * 7919 % classes).alias("z"), F.concat(F.lit("w"), code).alias("word"))
    for x in ("x", "word"):
        for y in ("y", "z"):
            score, case = power_score(df, x, y, fold_by=["id"])[2:4]
            assert score == 1.0 and case == ("classification" if y == "y" else "regression")


def test_constant_ids_and_few_rows(spark):
    df = spark.range(40).select("id", F.lit(5).alias("one"), F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("int").alias("never"))
    case = {(r["x"], r["y"]): (r["case"], r["score"]) for r in predictive_matrix(df).collect()}
    assert case["id", "one"] == ("target_is_constant", 1.0) and case["name", "id"] == ("feature_is_id", 0.0)
    assert case["id", "name"] == ("target_is_id", 0.0) and case["never", "id"] == case["id", "never"] == ("too_few_rows", 0.0)
    assert case["one", "id"][0] == "regression" and len(case) == 16
    assert [r["case"] for r in predictors(df.limit(0), "id", ["one"]).collect()] == ["too_few_rows"]


def test_one_count_and_no_fits(spark, monkeypatch):
    """All pairs come from one grouped count of the table, with partial sums before the shuffle."""
    from millrace.plans import power

    counted = power._cells(spark.range(50).select("id", (F.col("id") % 3).alias("a")), ["id", "a"], ["a"], F.lit(0))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and "Join" not in plan
    assert not hasattr(power, "DecisionTreeRegressor")


def test_pairs_are_not_exploded(spark, monkeypatch):
    """Only values of columns are written, and one row per slice, leaf and fold left open; not one per row and pair."""
    from millrace.plans import power

    written = []
    monkeypatch.setattr(power, "settled", lambda d: written.append(d.cache()) or written[-1])
    df = spark.range(4000).select("id", (F.col("id") * 7 % 4000).alias("a"), (F.col("id") * 11 % 4000).alias("b"), (F.col("id") % 3).cast("string").alias("c"))
    assert predictive_matrix(df, fold_by=["id"]).count() == 16
    assert sum(d.count() for d in written) < 4 * 4000
    # leaves of many rows in one fold only take the nearest guess of a slice far away
    spark.conf.set("millrace.rowsPerSlice", "100")
    try:
        keys = [i for i in range(4000) if fold(i) != 1]
        ones = [i for i in range(4000) if fold(i) == 1]
        rows = [(i, 10.0 + n, float(n % 5), "ab"[n % 2]) for n, i in enumerate(keys)] + [(i, 2.0, 7.0, "b") for i in ones]
        found = {r["y"]: r for r in scores(spark.createDataFrame(rows, "id int, x double, y double, side string"), ["x"], ["y", "side"], ["id"]).collect()}
    finally:
        spark.conf.unset("millrace.rowsPerSlice")
    for y, at, number in (("y", 2, True), ("side", 3, False)):
        baseline, model = brute([(r[0], r[1], r[at]) for r in rows], number)
        assert found[y]["model"] == pytest.approx(model, rel=1e-9)
        if number:
            assert found[y]["baseline"] == pytest.approx(baseline, rel=1e-9)
