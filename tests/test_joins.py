"""Joins against pandas, with hot and missing keys."""

import numpy as np
import pandas as pd
import pytest

import millrace as m


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 12, 80).astype(float), "j": rng.integers(0, 2, 80), "v": np.arange(80)})
    right = pd.DataFrame({"k": rng.integers(6, 18, 60).astype(float), "j": rng.integers(0, 2, 60), "v": np.arange(60), "w": np.arange(60) * 2})
    left.loc[:25, "k"] = 7.0
    left.loc[70:, "k"] = np.nan
    right.loc[:20, "k"] = 7.0
    right.loc[55:, "k"] = np.nan
    from pyspark.sql import functions as F

    def lift(pdf):
        return spark.createDataFrame(pdf).withColumn("k", F.when(~F.isnan("k"), F.col("k")))

    return left, right, lift(left), lift(right)


def rows(pdf):
    return sorted(tuple(-1e9 if x is None or x != x else float(x) for x in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot", ["check", "split", "ignore"])
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
def test_same_named_keys(sides, how, hot, on):
    left, right, sl, sr = sides
    want = left.merge(right, on=on, how=how)
    got = m.join(sl, sr, on=on, how=how, hot=hot).toPandas()
    assert list(got.columns) == list(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot", ["split", "ignore"])
def test_differently_named_keys(sides, how, hot):
    left, right, sl, sr = sides
    want = left.merge(right.rename(columns={"k": "key"}), left_on="k", right_on="key", how=how)
    got = m.join(sl, sr.withColumnRenamed("k", "key"), on=[("k", "key")], how=how, hot=hot).toPandas()
    assert list(got.columns) == list(want.columns)
    assert rows(got) == rows(want)


def test_a_hot_key_is_noticed(sides):
    _, _, sl, sr = sides
    spark = sl.sparkSession
    spark.conf.set("millrace.hotKeyRows", "10")
    try:
        plan = m.join(sl, sr, on="k", how="left")._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("millrace.hotKeyRows")
    assert "Union" in plan and "LeftAnti" in plan
    assert "Union" not in m.join(sl, sr, on="k", how="left")._jdf.queryExecution().analyzed().toString()


def test_right_column_choices(sides):
    _, _, sl, sr = sides
    assert m.join(sl, sr, "k", right_columns=["w"]).columns == ["k", "j", "v", "w"]
    assert m.join(sl, sr, "k", right_drop=["w", "k"], suffixes=("_l", "_r")).columns == ["k", "j_l", "v_l", "j_r", "v_r"]
    with pytest.raises(ValueError, match="no columns"):
        m.join(sl, sr, "nope")
    with pytest.raises(ValueError, match="unknown join"):
        m.join(sl, sr, "k", how="semi")


@pytest.mark.parametrize("tracked", [(65_536, 1_000_000), (64, 1_000_000), (64, 64)])
def test_hot_keys_by_a_summary(spark, monkeypatch, tracked):
    """The same answer by the first summary, a finer one and by counting, and no key column shuffled."""
    from pyspark.sql import functions as F

    from millrace.operators import joins

    monkeypatch.setattr(joins, "TRACKED", tracked[0])
    monkeypatch.setattr(joins, "MOST_TRACKED", tracked[1])
    n = F.col("id")
    # a thousand rows of one key over five thousand other keys; missing keys are one key
    table = spark.range(0, 10_000, 1, 8).select(F.when(n % 10 == 0, 7.5).when(n % 10 == 1, F.lit(None)).when(n % 10 == 2, F.lit("nan").cast("double")).otherwise(n % 5000 + 10_000.0).alias("k"), (n % 3).alias("j"))
    spark.conf.set("millrace.hotKeyRows", "1500")
    try:
        assert joins.has_hot_key(table, ["k"])
        assert not joins.has_hot_key(table, ["k", "j"])
        assert not joins.has_hot_key(table.where("k IS NOT NULL AND NOT isnan(k)"), ["k"])
        assert not joins.has_hot_key(table.limit(0), ["k"])
    finally:
        spark.conf.unset("millrace.hotKeyRows")
