"""Sliced running calculations and quantiles against plain windows and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators import ordered
from millrace.operators.ordered import Measure, number_rows, running, slice_rows
from millrace.operators.quantiles import quantiles


def frame(spark, n=600, hot=True):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.4 if hot else np.zeros(n, bool), "hot", rng.integers(0, 30, n).astype(str)),
        "day": rng.integers(0, 50, n),
        "v": np.round(rng.normal(size=n), 3),
    })
    pdf["g"] = pdf["g"].where(rng.random(n) > 0.05, None)
    sdf = spark.createDataFrame(pdf).repartition(5)
    return pdf, sdf.withColumn("v", F.when(F.col("id") % 4 != 0, F.col("v")))


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_matches_a_plain_window(thin_slices, by, reverse):
    _, df = frame(thin_slices)
    sliced = slice_rows(df, by, ["day", "id"])
    assert sliced.owners is not None
    measures = [
        Measure("s", "sum", F.col("v")), Measure("n", "count", F.col("v")), Measure("p", "product", F.col("v") + 2),
        Measure("l", "last", F.col("v")), Measure("b", "last", F.col("v"), exclusive=True), Measure("t", "total", F.col("v")),
    ]
    got = running(sliced, measures, reverse).rows().toPandas().sort_values("id")
    whole = slice_rows(df, by, ["day", "id"], rows=1)
    assert whole.owners is None
    want = running(whole, measures, reverse).rows().toPandas().sort_values("id")
    for c in "snplbt":
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_slices_follow_the_order(thin_slices):
    _, df = frame(thin_slices)
    sliced = slice_rows(df, [], ["day", "id"])
    ends = sliced.df.groupBy("__slice").agg(F.min(F.struct("day", "id")).alias("a"), F.max(F.struct("day", "id")).alias("b"), F.count("*").alias("n"))
    rows = sorted(ends.collect(), key=lambda r: r["__slice"])
    assert len(rows) > 5
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(rows, rows[1:]))
    assert max(r["n"] for r in rows) < 200


def test_a_position_shared_by_a_third_of_all_rows_is_split(thin_slices):
    df = thin_slices.range(600).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("day"), F.lit(1).alias("one"))
    sliced = slice_rows(df, [], ["day"])
    sizes = [r["count"] for r in sliced.df.groupBy("__slice").count().collect()]
    assert max(sizes) < 150
    numbered = number_rows(df, ["day"], "i").collect()
    assert sorted(r["i"] for r in numbered) == list(range(600))
    by_place = sorted(numbered, key=lambda r: r["i"])
    assert [r["day"] for r in by_place] == sorted(r["day"] for r in numbered)
    assert numbered[0].asDict().keys() == {"day", "one", "i"}


def test_order_is_required(spark):
    with pytest.raises(ValueError, match="order_by"):
        m.fill_missing(spark.range(3), "id", how="ffill")


@pytest.mark.parametrize("kind", ["timestamp", "date", "string", "decimal(12,3)", "double", "boolean"])
def test_every_order_type_survives_the_cut_points(thin_slices, kind):
    base = thin_slices.range(300).withColumn("u", F.col("id") * 7 % 300)
    if kind == "timestamp":
        c = F.timestamp_micros(F.col("u") * 1_234_567_890_123)
    elif kind == "date":
        c = F.date_add(F.lit("1969-06-01").cast("date"), F.col("u").cast("int"))
    elif kind == "boolean":
        c = F.col("u") % 2 == 0
    elif kind == "string":
        c = F.concat(F.lit("é\"'"), F.col("u").cast("string"))
    else:
        c = (F.col("u") / 7).cast(kind)
    df = base.withColumn("k", F.when(F.col("u") > 5, c))
    got = number_rows(df, ["k", "id"], "i").toPandas()
    want = number_rows_plain(df, ["k", "id"]).toPandas()
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert (merged["i"] == merged["i_w"]).all()


def test_long_texts_and_odd_numbers_as_order(thin_slices):
    odd = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, float("inf")).when(F.col("id") % 17 == 0, float("-inf"))
    df = thin_slices.range(400).select(
        "id", odd.otherwise((F.col("id") * 7 % 400) / 3 - 60).alias("v"), F.encode(F.concat(F.lit("k"), F.col("id") % 19), "utf-8").alias("raw"),
        F.concat(F.repeat(F.lit("x"), 300), (F.col("id") * 7 % 50).cast("string")).alias("text"),
    )
    for order in (["v", "id"], ["raw", "id"], ["text", "id"], ["text", "v", "id"]):
        got = number_rows(df, order, "i").toPandas()
        want = number_rows_plain(df, order).toPandas()
        assert (got.merge(want, on="id", suffixes=("", "_w")).eval("i == i_w")).all(), order


def number_rows_plain(df, order):
    from pyspark.sql import Window

    return df.select("id", (F.row_number().over(Window.orderBy(*[F.col(o).asc_nulls_last() for o in order])) - 1).alias("i"))


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_quantiles(thin_slices, keys):
    _, df = frame(thin_slices)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, keys, {"q": ("v", probs), "w": ("day", [0.5])}).collect()
    pdf = df.toPandas()
    groups = pdf.groupby("g", dropna=False) if keys else [(None, pdf)]
    want = {k if isinstance(k, str) else None: g for k, g in groups}
    assert len(got) == len(want)
    for r in got:
        g = want[r["g"] if keys else None]
        values = g["v"].dropna()
        if len(values):
            np.testing.assert_allclose(r["q"], np.quantile(values, probs), rtol=1e-12)
        assert r["w"][0] == np.quantile(g["day"], 0.5)


def test_median_of_a_group_without_values(thin_slices):
    df = thin_slices.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 8.0), ("a", 9.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["v_median"] for r in m.group_agg(df, "g", [("median", ["v"])]).collect()}
    assert got == {"a": 4.0, "b": None}


def test_slice_numbers_do_not_depend_on_partitions(thin_slices):
    _, df = frame(thin_slices)
    sliced = slice_rows(df, ["g"], ["day", "id"])
    a = {r["id"]: r["__slice"] for r in sliced.df.select("id", "__slice").collect()}
    b = {r["id"]: r["__slice"] for r in sliced.df.repartition(3, "v").select("id", "__slice").collect()}
    assert a == b and ordered.SLICE == "__slice"


def sizes(sliced):
    return [r["count"] for r in sliced.df.groupBy("__slice").count().collect()]


@pytest.mark.parametrize("shared", [300, 5_000])
def test_order_texts_with_a_long_shared_beginning_spread_without_a_checkpoint(spark, monkeypatch, shared):
    monkeypatch.setattr(ordered, "settled", None)  # a checkpoint would fail
    spark.conf.set("millrace.rowsPerSlice", "1000")
    try:
        df = spark.range(8000).select("id", F.concat(F.repeat(F.lit("x"), shared), F.format_string("%05d", F.col("id") * 7919 % 8000)).alias("text"))
        assert max(sizes(slice_rows(df, [], ["text"]))) < 2500
        got = number_rows(df, ["text"], "i").select("id", "i")
        assert got.where(F.col("i") != F.col("id") * 7919 % 8000).count() == 0
    finally:
        spark.conf.unset("millrace.rowsPerSlice")


def test_beginnings_shared_at_several_depths(thin_slices, monkeypatch):
    """Runs of equal characters inside runs, next to short, missing and other texts, two text columns and a number."""
    monkeypatch.setattr(ordered, "CUT_LENGTH", 8)
    n = F.col("id")
    text = (
        F.when(n % 7 == 0, F.concat(F.repeat(F.lit("é"), 20), n.cast("string")))
        .when(n % 7 == 1, F.concat(F.repeat(F.lit("é"), 50), F.lpad(n.cast("string"), 30, "0")))
        .when(n % 7 == 2, F.repeat(F.lit("é"), 30)).when(n % 7 == 3, F.lit("short")).when(n % 7 == 5, F.concat(F.lit("zz"), n.cast("string")))
    )
    df = thin_slices.range(1400).select("id", text.alias("a"), F.concat(F.repeat(F.lit("b"), 40), n * 13 % 1400).alias("b"), (n % 9).alias("v"))
    for order in (["a", "v", "b"], ["a", "b"]):
        sliced = slice_rows(df, [], order)
        assert max(sizes(sliced)) < 140, order
        got = number_rows(df, order, "i").toPandas()
        want = number_rows_plain(df, order).toPandas()
        assert (got.merge(want, on="id", suffixes=("", "_w")).eval("i == i_w")).all(), order


def test_ties_of_long_texts_are_still_split(thin_slices):
    df = thin_slices.range(600).select("id", F.concat(F.repeat(F.lit("x"), 400), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))).alias("text"))
    assert max(sizes(slice_rows(df, [], ["text"]))) < 150
    numbered = number_rows(df, ["text"], "i").collect()
    assert sorted(r["i"] for r in numbered) == list(range(600))
    assert [r["text"] for r in sorted(numbered, key=lambda r: r["i"])] == sorted(r["text"] for r in numbered)


def test_group_keys_as_long_as_documents(thin_slices):
    from pyspark.sql import Window

    group = F.concat(F.repeat(F.lit("long "), 4000), F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    df = thin_slices.range(800).select("id", group.alias("g"), (F.col("id") * 7 % 800).alias("o"), (F.col("id") % 5).alias("v"))
    sliced = slice_rows(df, ["g"], ["o"])
    assert max(sizes(sliced)) < 200
    assert all(len(str(v)) < 300 for r in sliced.owners.collect() for v in r)
    got = running(sliced, [Measure("s", "sum", F.col("v")), Measure("l", "last", F.col("v"), exclusive=True)]).rows()
    upto = Window.partitionBy("g").orderBy("o")
    want = df.select("id", F.sum("v").over(upto).alias("s"), F.lag("v").over(upto).alias("l"))
    assert got.select("id", "s", "l").exceptAll(want).count() == 0


def test_the_number_of_slices_is_a_setting(thin_slices):
    thin_slices.conf.set("millrace.maxSlices", "3")
    try:
        assert len(sizes(slice_rows(thin_slices.range(600), [], ["id"]))) == 3
    finally:
        thin_slices.conf.unset("millrace.maxSlices")


def test_fills_with_equal_times(spark, thin_slices):
    """With ``order_by`` the last row of a time stands for it; missing order values are last."""
    rows = [(f"2024-01-0{d} {h:02d}:30:00", i, float(10 * d + i)) for d in (1, 3) for h in (4, 9) for i in range(60)] + [("2024-01-03 09:30:00", None, -1.0)]
    df = spark.createDataFrame(rows, "ts string, i int, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    with pytest.raises(ValueError, match="duplicates"):
        m.resample(df, "ts", 1, "D", "ffill", columns=["v"])
    for how, want in (("ffill", [None, 69.0, 69.0]), ("bfill", [69.0, 89.0, 89.0])):
        got = {r["ts"].day: r["v"] for r in m.resample(df, "ts", 1, "D", how, columns=["v"], order_by=["i"]).collect()}
        assert [got[d] for d in (1, 2, 3)] == want
    later = m.resample(df, "ts", 12, "H", "ffill", columns=["v"], order_by=["i"]).unionAll(m.resample(df.unionAll(df), "ts", 12, "H", "ffill", columns=["v"], order_by=["i"]))
    assert {r["v"] for r in later.where("ts = '2024-01-01 12:00:00'").collect()} == {69.0}
    assert m.resample(df.where("i IS NULL OR i = 3"), "ts", 1, "min", "asfreq", columns=["v"], order_by=["i"]).where("v = -1").count() == 1
