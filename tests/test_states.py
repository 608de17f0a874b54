"""Stored states against exact facts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators.states import sketch_size


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    rows = spark.range(0, 30_000, 1, 6)
    return rows.select(
        (n % 3).alias("day"), (n * 7919 % 30_000).cast("double").alias("x"), F.when(n % 4 == 0, F.lit(None)).otherwise((n % 1000).cast("string")).alias("t"),
        F.lit(None).cast("int").alias("none"), F.when(n % 2 == 0, F.lit("nan").cast("double")).otherwise(n % 11).alias("holes"),
    )


def facts(states):
    return {r["column"]: r for r in m.state_facts(states).collect()}


def test_states_of_parts_merge_into_the_whole(table, spark, tmp_path):
    for day in range(3):
        m.column_states(table.where(F.col("day") == day), ["x", "t", "none", "holes"]).write.parquet(f"{tmp_path}/{day}")
    stored = spark.read.parquet(*[f"{tmp_path}/{day}" for day in range(3)])
    for states in (m.merge_states(stored), m.column_states(table, ["x", "t", "none", "holes"])):
        got = facts(states)
        assert {c: (r["rows"], r["missing_count"]) for c, r in got.items()} == {"x": (30_000, 0), "t": (30_000, 7_500), "none": (30_000, 30_000), "holes": (30_000, 15_000)}
        assert abs(got["x"]["unique_count"] - 30_000) <= 900 and abs(got["t"]["unique_count"] - 750) <= 15 and got["none"]["unique_count"] == 0 and got["holes"]["unique_count"] == 11
        assert all(abs(q - p * 30_000) <= 300 for q, p in zip(got["x"]["quantiles"], (0.25, 0.5, 0.75)))
        assert got["t"]["quantiles"] is None and got["none"]["quantiles"] is None and got["holes"]["quantiles"][1] in (4, 5, 6)


def test_states_per_group(table):
    got = m.state_facts(m.column_states(table, ["x", "t"], by=["day"])).collect()
    assert len(got) == 6 and {r["rows"] for r in got} == {10_000}
    assert m.column_states(table.limit(0), ["x"], by=["day"]).count() == 0
    empty = facts(m.column_states(table.limit(0), ["x"]))["x"]
    assert (empty["rows"], empty["missing_count"], empty["unique_count"], empty["quantiles"]) == (0, 0, 0, None)
    with pytest.raises(ValueError, match="cannot name groups"):
        m.column_states(table.withColumnRenamed("day", "rows"), ["x"], by=["rows"])


def test_median_margins_from_merged_sketches(table):
    got = m.pivot_table(table.withColumn("c", (F.col("x") % 2).cast("int").cast("string")), ["day"], ["c"], "x", "median", margins=True, accuracy=200)
    rows = {r["day"]: r.asDict() for r in got.collect()}
    assert set(rows) == {"0", "1", "2", "All"}
    pdf = table.select("day", "x").toPandas()
    pdf["c"] = (pdf.x % 2).astype(int).astype(str)
    for day in ("0", "1", "2", "All"):
        for c in ("0", "1", "All"):
            part = pdf[(pdf.day.astype(str) == day) | (day == "All")]
            part = np.sort(part[(part.c == c) | (c == "All")].x.to_numpy())
            rank = np.searchsorted(part, rows[day][c]) / len(part)
            assert abs(rank - 0.5) <= 1 / 200
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("kll_sketch_agg_double") == 1


def test_sketch_sizes():
    assert sketch_size(1) == 8 and sketch_size(10**6) == 65_535 and 400 < sketch_size(100) < 450
    with pytest.raises(ValueError):
        sketch_size(0)
