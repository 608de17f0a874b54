"""A source of ranges: each row read once, in several tasks."""

import pytest
from pyspark.sql import functions as F

import millrace as m


def test_ranges_of_files(spark, tmp_path):
    folder = f"{tmp_path}/rows.parquet"
    spark.range(0, 50_000, 1, 3).select("id", (F.col("id") % 7).cast("string").alias("t")).write.option("parquet.block.size", 65_536).parquet(folder)
    m.ranged_source("rows by ranges", "id bigint, t string", m.parquet_ranges, m.read_parquet_range)
    got = m.load("rows by ranges", spark, path=folder, columns="id, t", bytes_per_range=20_000)
    assert got.agg(F.count(F.lit(1)), F.count_distinct("id"), F.sum("id")).first()[:] == (50_000, 50_000, 50_000 * 49_999 // 2)
    assert got.where("t <> CAST(id % 7 AS STRING)").isEmpty() and got.rdd.getNumPartitions() > 3


def test_ranges_of_ones_own(spark):
    def split(options):
        return [(k, int(options["step"])) for k in range(0, int(options["rows"]), int(options["step"]))]

    def read(options, one):
        first, step = one
        return ((k, None if k % 5 == 0 else f"row {k}") for k in range(first, min(first + step, int(options["rows"]))))

    m.ranged_source("numbers", "k int, t string", split, read)
    got = m.load("numbers", spark, rows=23, step=5)
    assert sorted(got.collect()) == [(k, None if k % 5 == 0 else f"row {k}") for k in range(23)] and got.rdd.getNumPartitions() == 5
    assert m.load("numbers", spark, rows=0, step=5).count() == 0
    with pytest.raises(ValueError, match="no source"):
        m.load("others", spark)
