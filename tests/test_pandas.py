"""Binning, resampling, running calculations and pivot tables against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators.binning import equal_edges, interval_texts
from millrace.plans import profile

# pandas names of the frequency units
PANDAS = {"D": "D", "B": "B", "H": "h", "min": "min", "S": "s", "W": "W", "MS": "MS", "M": "ME", "SMS": "SMS", "SM": "SME",
          "QS": "QS", "Q": "QE", "AS": "YS", "A": "YE", "ms": "ms", "us": "us"}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    start = np.datetime64("2023-12-29T08:30:00", "us")
    ts = start + np.sort(rng.choice(500 * 24 * 60, 300, replace=False)).astype("timedelta64[m]")
    extra = np.array(["2024-01-15", "2024-01-31T12:00", "2024-02-14T23:59:59", "2024-02-15", "2024-02-29", "2024-03-31", "2024-06-30",
                      "2024-12-31T23:59:59.999999", "2025-01-01", "2024-01-07", "2024-01-06T05:00"], dtype="datetime64[us]")
    ts = np.unique(np.concatenate([ts, extra]))
    pdf = pd.DataFrame({"ts": ts, "v": np.round(rng.normal(10, 3, len(ts)), 2)})
    pdf.loc[::7, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(4)
    return pdf, sdf.cache()


def same(got, want, columns):
    got = got.sort_values(columns[0]).reset_index(drop=True)
    want = want.sort_values(columns[0]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in columns:
        if np.issubdtype(want[c].dtype, np.datetime64):
            assert (got[c].astype("datetime64[us]") == want[c].astype("datetime64[us]")).all(), c
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("unit,every", [("D", 1), ("D", 5), ("B", 1), ("B", 3), ("H", 6), ("H", 7), ("W", 1), ("W", 2), ("W", 3), ("MS", 1), ("MS", 2), ("M", 1), ("M", 2),
                                        ("M", 5), ("SMS", 1), ("SMS", 3), ("SM", 1), ("QS", 1), ("QS", 3), ("Q", 1), ("Q", 2), ("AS", 1), ("A", 1), ("A", 2), ("min", 90)])
def test_resample_sum(series, unit, every):
    pdf, sdf = series
    want = pdf.set_index("ts").resample(f"{every}{PANDAS[unit]}").sum().reset_index()
    same(m.resample(sdf, "ts", every, unit, "sum").toPandas(), want, ["ts", "v"])


@pytest.mark.parametrize("how", ["count", "nunique", "mean", "median", "min", "max", "first", "last", "std", "var", "sem", "prod"])
def test_resample_functions(series, how):
    pdf, sdf = series
    want = getattr(pdf.set_index("ts").resample("3D"), how)().reset_index()
    same(m.resample(sdf, "ts", 3, "D", how).toPandas(), want, ["ts", "v"])


def test_resample_ohlc(series):
    pdf, sdf = series
    want = pdf.set_index("ts").resample("MS").ohlc()
    want.columns = ["_".join(c) for c in want.columns]
    got = m.resample(sdf, "ts", 1, "MS", "ohlc").toPandas()
    same(got, want.reset_index(), ["ts", "v_open", "v_high", "v_low", "v_close"])


@pytest.mark.parametrize("how,method", [("asfreq", "asfreq"), ("ffill", "ffill"), ("bfill", "bfill"), ("nearest", "nearest")])
@pytest.mark.parametrize("unit,every", [("D", 1), ("H", 6), ("MS", 1), ("W", 1), ("M", 1)])
def test_resample_fills(series, how, method, unit, every):
    pdf, sdf = series
    want = getattr(pdf.set_index("ts").resample(f"{every}{PANDAS[unit]}"), method)().reset_index()
    same(m.resample(sdf, "ts", every, unit, how).toPandas(), want, ["ts", "v"])


@pytest.mark.parametrize("thin", [False, True])
def test_interpolation_on_a_regular_grid(spark, thin, request):
    if thin:
        request.getfixturevalue("thin_slices")
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    pdf = pd.DataFrame({"ts": days, "v": np.arange(200.0) ** 1.5})
    pdf = pdf[np.random.default_rng(2).random(200) < 0.4]
    want = pdf.set_index("ts").resample("D").interpolate().reset_index()
    same(m.resample(spark.createDataFrame(pdf), "ts", 1, "D", "interpolate").toPandas(), want, ["ts", "v"])


@pytest.mark.parametrize("how", ["ffill", "bfill", "nearest"])
def test_fills_over_slices(series, thin_slices, how):
    pdf, sdf = series
    want = getattr(pdf.set_index("ts").resample("8h"), how)().reset_index()
    same(m.resample(sdf, "ts", 8, "H", how).toPandas(), want, ["ts", "v"])


def test_fill_by_group(series, spark):
    pdf, sdf = series
    tagged = sdf.withColumn("g", (F.hash("ts") % 2 == 0).cast("string"))
    local = tagged.toPandas()
    for g, part in local.groupby("g"):
        want = part[["ts", "v"]].sort_values("ts").set_index("ts").resample("D").ffill().reset_index()
        got = m.resample(tagged, "ts", 1, "D", "ffill", by="g").where(F.col("g") == g).toPandas()
        same(got, want, ["ts", "v"])


def test_duplicates_cannot_be_filled(spark, series):
    _, sdf = series
    with pytest.raises(ValueError, match="duplicates"):
        m.resample(sdf.unionAll(sdf), "ts", 1, "D", "ffill")
    with pytest.raises(ValueError, match="nanosecond"):
        m.resample(sdf, "ts", 1, "N", "sum")


VALUES = np.round(np.random.default_rng(8).gamma(2.0, 30.0, 200), 6)


@pytest.fixture(scope="module")
def numbers(spark):
    pdf = pd.DataFrame({"i": np.arange(200), "v": VALUES})
    return pdf, spark.createDataFrame(pdf)


def bins_of(df):
    return [r["bin"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("bins", [1, 4, 7, 100])
@pytest.mark.parametrize("closed", ["right", "left"])
def test_bin_equal(numbers, bins, closed):
    pdf, sdf = numbers
    want = pd.cut(pdf["v"], bins, right=closed == "right")
    assert bins_of(m.bin_equal(sdf, "v", bins, closed, into="bin")) == [str(x) for x in want]
    codes = bins_of(m.bin_equal(sdf, "v", bins, closed, labels=("asc", 3), into="bin"))
    assert codes == list(want.cat.codes + 3)
    down = bins_of(m.bin_equal(sdf, "v", bins, closed, labels=("desc", 1), into="bin"))
    assert down == list(bins - want.cat.codes)


@pytest.mark.parametrize("closed", ["right", "left"])
@pytest.mark.parametrize("width,lo,hi", [(10, 0, 100), (12.5, None, None), (7, 5, 61)])
def test_bin_width(numbers, closed, width, lo, hi):
    pdf, sdf = numbers
    a, b = (pdf["v"].min() if lo is None else lo), (pdf["v"].max() if hi is None else hi)
    edges = list(np.arange(a, b, width))
    if b not in edges:
        edges.append(b)
    want = pd.cut(pdf["v"], [float(e) for e in edges], right=closed == "right", include_lowest=closed == "right")
    got = bins_of(m.bin_width(sdf, "v", width, lo, hi, closed, into="bin"))
    assert got == [None if x is np.nan or x != x else str(x) for x in want]


@pytest.mark.parametrize("q", [2, 4, 10])
def test_bin_quantile(numbers, q, thin_slices):
    pdf, sdf = numbers
    want = pd.qcut(pdf["v"], q)
    assert bins_of(m.bin_quantile(sdf, "v", q, into="bin")) == [str(x) for x in want]


def test_quantile_edges_must_differ(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "v double")
    with pytest.raises(ValueError, match="repeat"):
        m.bin_quantile(df, "v", 4)


def test_custom_bins(numbers):
    pdf, sdf = numbers
    got = bins_of(m.bin_custom(sdf, "v", [(0, 20, "low"), (50, 80, "mid")], into="bin"))
    assert got == ["low" if 0 < x <= 20 else "mid" if 50 < x <= 80 else None for x in pdf["v"]]
    with pytest.raises(ValueError, match="overlap"):
        m.bin_custom(sdf, "v", [(0, 20, "a"), (10, 30, "b")])
    with pytest.raises(ValueError, match="repeat"):
        m.bin_custom(sdf, "v", [(0, 20, "a"), (20, 30, "a")])


@pytest.mark.parametrize("values", [[0.00012345, 0.00012399, 0.5], [5.0, 5.0], [1e6, 3e6, 1234567.891], [-3.25, 0.0, 8.125]])
@pytest.mark.parametrize("precision", [1, 3])
def test_interval_texts(values, precision):
    want = pd.cut(pd.Series(values), 3, precision=precision).cat.categories
    assert interval_texts(equal_edges(min(values), max(values), 3), "right", precision) == [str(x) for x in want]


def test_density_labels(numbers):
    pdf, sdf = numbers
    pdf = pdf.assign(w=pdf["i"] * 1.5)
    got = profile.density_2d(sdf.withColumn("w", F.col("i") * 1.5), "v", "w", 5, 4).toPandas()
    want = pd.crosstab(pd.cut(pdf["v"], 5, right=False, precision=1), pd.cut(pdf["w"], 4, right=False, precision=1), dropna=False)
    table = got.pivot(index="x_range", columns="y_range", values="count")
    for x in want.index:
        for y in want.columns:
            assert table.loc[str(x), str(y)] == want.loc[x, y]
    assert got["count"].sum() == 200


@pytest.mark.parametrize("fn", ["mean", "sum", "count", "median", "min", "max", "std", "nunique"])
@pytest.mark.parametrize("margins", [False, True])
def test_pivot_table(spark, fn, margins):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"r": rng.choice(["a", "b", "c"], 60), "s": rng.choice(["p", "q"], 60), "c": rng.choice(["x", "y", "z"], 60), "v": rng.normal(size=60).round(3)})
    want = pdf.pivot_table(index=["r", "s"], columns="c", values="v", aggfunc=fn, margins=margins).reset_index()
    got = m.pivot_table(spark.createDataFrame(pdf), ["r", "s"], "c", "v", fn, margins=margins).toPandas()
    assert list(got.columns) == list(want.columns)
    got, want = got.sort_values(["r", "s"]), want.sort_values(["r", "s"])
    assert (got[["r", "s"]].to_numpy() == want[["r", "s"]].to_numpy()).all()
    np.testing.assert_allclose(got.iloc[:, 2:].to_numpy(float), want.iloc[:, 2:].to_numpy(float), rtol=1e-9)


@pytest.mark.parametrize("by", [None, "g"])
def test_percentage_change(spark, by):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"i": np.arange(80), "g": rng.choice(["a", "b"], 80), "v": rng.normal(5, 1, 80)})
    pdf.loc[::5, "v"] = np.nan
    filled = pdf.groupby("g")["v"].ffill() if by else pdf["v"].ffill()
    base = filled.groupby(pdf["g"]) if by else filled
    want = (base.pct_change(fill_method=None) if by else base.pct_change(fill_method=None)).to_numpy()
    sdf = spark.createDataFrame(pdf)
    got = m.pct_change(sdf, "v", order_by=["i"], by=by).orderBy("i").toPandas()["v_pct_change"].to_numpy(float)
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)
