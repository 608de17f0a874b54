"""Registered queries: a key, a builder over the given tables, and the same question in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.contract import quoted
from millrace.session import pin
from millrace.sources.readers import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Loads the given tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = pin(spark), folder

    def __call__(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")


def query(key: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"query {key!r} is registered twice")
    QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
    if sql is not None:
        ORACLES[key] = sql


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round float columns, for comparing results of sums in different orders."""
    chosen = names or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.round(quoted(n), digits) for n in chosen})


def scratch(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads back."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="millrace-") + "/data"
