"""NaN and NULL are one missing value in keys, and missing order keys come last."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.plans import profile

ROWS = [("a", None, 1.0), ("a", 2, 2.0), ("a", 1, 3.0), ("b", None, 4.0)]


@pytest.fixture
def ordered(spark):
    return spark.createDataFrame(ROWS, "k string, o int, v double")


def test_order_keys(ordered):
    for fn, want in (("first", {"a": 3.0, "b": 4.0}), ("last", {"a": 1.0, "b": 4.0})):
        got = m.group_agg(ordered, ["k"], {"x": ("v", fn)}, order_by=["o"]).collect()
        assert {r["k"]: r["x"] for r in got} == want
        kept = m.drop_duplicates(ordered, ["k"], keep=fn, order_by=["o"]).collect()
        assert {r["k"]: r["v"] for r in kept} == want


@pytest.mark.parametrize("order,kinds", [(["o"], "long"), (["o"], "double"), (["o"], "timestamp"), (["o"], "boolean"), (["t", "o"], "long"), (["t", "o"], "int"), (["o", "t"], "string"), (["o", "t"], "date")])
def test_picks_keep_the_order_of_missing_and_extreme_keys(spark, order, kinds):
    extremes = {
        "long": [None, -(2**63), 2**63 - 1, 0, 5], "int": [None, -(2**31), 2**31 - 1, 0], "double": [None, math.nan, math.inf, -math.inf, 1.5],
        "timestamp": [None, dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1)],
        "date": [None, dt.date(1, 1, 1), dt.date(9999, 12, 31)], "boolean": [None, True, False], "string": [None, "", "b", "a"],
    }[kinds]
    times = [None, dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31), dt.datetime(2020, 2, 29)] if "t" in order else [dt.datetime(2000, 1, 1)]
    rows = [(o, t) for o in extremes for t in times]
    lost = lambda x: x is None or x != x
    at = lambda r: [(lost(x), 0 if lost(x) else x) for x in (r[["o", "t"].index(n)] for n in order)]
    random.Random(1).shuffle(rows)
    for keep in range(1, len(rows) + 1):
        some = rows[:keep]
        if keep % 3 and keep < len(rows):
            continue
        data = [(o, t, None if k % 4 == 3 else float(k)) for k, (o, t) in enumerate(some)]
        df = spark.createDataFrame(data, f"o {kinds}, t timestamp, v double")
        got = m.group_agg(df, [], {"f": ("v", "first"), "l": ("v", "last")}, order_by=order).first()
        known = sorted(((at(d), d[2]) for d in data if d[2] is not None), key=lambda p: p[0])
        ends = [{v for p, v in known if p == known[e][0]} for e in (0, -1)]
        assert got["f"] in ends[0] and got["l"] in ends[1], (some, got)


def test_picks_need_no_sort(spark):
    df = spark.range(9).select((F.col("id") % 2).alias("g"), F.when(F.col("id") > 2, F.col("id")).alias("o"), F.timestamp_seconds("id").alias("t"), (F.col("id") / 3).alias("v"), F.col("id").cast("string").alias("s"))
    for order, sorts in ((["o"], False), (["t"], False), (["v"], False), (["t", "o"], False), (["s"], True)):
        picked = m.group_agg(df, ["g"], {"f": ("v", "first"), "l": ("v", "last")}, order_by=order)
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert ("SortAggregate" in plan) == sorts, order
        assert sorts or plan.count("HashAggregate") >= 2


def test_float_keys(spark):
    df = spark.createDataFrame([(math.nan, 1), (None, 2), (1.0, 3)], "x double, n int")
    assert m.drop_duplicates(df.select("x")).count() == 2
    assert m.drop_duplicates(df, ["x"], order_by=["n"]).count() == 2
    other = spark.createDataFrame([(None, "none"), (1.0, "one")], "x double, t string")
    got = {(r["n"], r["t"]) for r in m.join(df, other, on=["x"], how="left").collect()}
    assert got == {(1, "none"), (2, "none"), (3, "one")}


def test_pivot_headings(spark):
    df = spark.createDataFrame([("r", True, 1e7, 1), ("r", False, 0.1, 2), ("All", True, 1e7, 4)], "r string, b boolean, d double, v int")
    assert set(m.pivot_table(df, "r", "b", "v", "sum").columns) == {"r", "true", "false"}
    assert set(m.pivot_table(df, "r", "d", "v", "sum").columns) == {"r", "1.0E7", "0.1"}
    with pytest.raises(ValueError, match="margins_name"):
        m.pivot_table(df, "r", "b", "v", "sum", margins=True)
    total = m.pivot_table(df, "r", "b", "v", "sum", margins=True, margins_name="Total").where("r = 'Total'").first()
    assert (total["true"], total["false"], total["Total"]) == (5, 2, 7)


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (math.inf,)], "x double")
    assert sum(r["count"] for r in profile.histogram(df, "x").collect()) == 2
    assert profile.histogram(df, "x", lo=1, hi=1).count() > 0
    with pytest.raises(ValueError, match="finite"):
        profile.histogram(df, "x", lo=0, hi=math.inf)
