"""Loaders that say which ranges there are and how to read one; Spark reads the ranges in as many tasks.

``ranged_source("sensor log", "t timestamp, v double", split, read)`` registers one for ``load``, next to
the loaders that return a DataFrame. ``split(options)`` runs once, on the driver, and lists the ranges
(anything that can be pickled, say file names with offsets); ``read(options, one)`` runs in a task and
yields Arrow record batches or tuples. A lost task reads its range again, so a range must always hold
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.readers import register_source

BYTES_PER_RANGE = 128 << 20


def ranged_source(name: str, schema: str | Callable[[dict], Any], split: Callable[[dict], Sequence], read: Callable[[dict, Any], Iterable]) -> None:
    """Make a source of ranges available to ``load`` under a name; options arrive as texts."""
    spark_name = "millrace_" + "".join(c if c.isalnum() else "_" for c in name)

    class Range(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [Range(one) for one in split(self.options)] or [Range(None)]

        def read(self, partition):
            # without any range there is one empty task, as Spark asks for at least one
            return iter(()) if partition.value is None else iter(read(self.options, partition.value))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return spark_name

        def schema(self):
            return schema(dict(self.options)) if callable(schema) else schema

        def reader(self, schema):
            return Reader(dict(self.options))

    def opened(spark: SparkSession, **options) -> DataFrame:
        spark.dataSource.register(Source)
        return spark.read.format(spark_name).options(**{k: str(v) for k, v in options.items()}).load()

    register_source(name)(opened)


def parquet_ranges(options: dict) -> list[tuple[str, int, int]]:
    """Byte ranges of the Parquet files at ``path`` (a file, a folder or an address); footers are not read."""
    from pyarrow import fs

    path, step = options["path"], int(options.get("bytes_per_range", BYTES_PER_RANGE))
    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
    return [(name, at, min(at + step, size)) for name, size in files for at in range(0, size, step)]


def read_parquet_range(options: dict, one: tuple[str, int, int]):
    """The row groups that begin within a byte range, so that each is read by exactly one task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    path, (name, start, end) = options["path"], one
    system = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")[0]
    with system.open_input_file(name) as opened:
        file = pq.ParquetFile(opened)
        groups = []
        for g in range(file.metadata.num_row_groups):
            first = file.metadata.row_group(g).column(0)
            begins = first.dictionary_page_offset if first.has_dictionary_page else first.data_page_offset
            if start <= begins < end:
                groups.append(g)
        if groups:
            columns = [c.strip() for c in options["columns"].split(",")]
            for batch in file.iter_batches(row_groups=groups, columns=columns):
                yield batch.select(columns)
