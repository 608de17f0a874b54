"""Helpers the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that separate words, as the inside of a character class.
BLANKS = " \\t\\n\\x0B\\f\\r"
#: Marks of ``perhaps_among``, 4 MB at most in every task.
MARKS = 1 << 25


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that every executor sees; a local session without one makes its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table as written to the shared folder, cut from its lineage."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def folder_of(df: DataFrame) -> str | None:
    """The folder behind a table of ``written``; None if it has no files."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def dropped(df: DataFrame | None) -> None:
    """Remove the files behind a table of ``written`` that is no longer needed."""
    name = folder_of(df) if df is not None else None
    if name:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def perhaps_among(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose ``name`` is among those of ``keys``, and few others: what a join of both need not shuffle goes. Marks of the keys' hashes are broadcast."""
    if df.schema[name].dataType != keys.schema[name].dataType:  # equal values of two types differ in their hashes
        return df
    mark = F.pmod(F.xxhash64(name), F.lit(MARKS)) + 1
    part, bit = F.bitmap_bucket_number(mark), F.bitmap_bit_position(mark)
    marks = keys.select(part.alias("_part"), bit.alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    found = df.select("*", part.alias("_part"), bit.alias("_bit")).join(F.broadcast(marks), "_part")
    return found.where("shiftright(cast(conv(hex(substring(_marks, cast(_bit div 8 + 1 AS int), 1)), 16, 10) AS int), cast(_bit % 8 AS int)) % 2 = 1").select(*df.columns)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def stored(folder: str) -> Iterator[pq.ParquetFile]:
    """The Parquet files of a shared folder, opened one after the other inside a task."""
    files, path = place(folder)
    for found in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if found.path.endswith(".parquet"):
            with files.open_input_file(found.path) as source:
                yield pq.ParquetFile(source)


def read_table(folder: str) -> pa.Table:
    """A table of bounded size from a shared folder, inside a task."""
    return pa.concat_tables([f.read() for f in stored(folder)])


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as bytes; a missing text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a missing text is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def in_slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, so that only their values become Python objects at once."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int | None = None) -> DataFrame:
    """Map Arrow batches, cut into slices of ``rows`` if given. ``make`` runs once in each task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in in_slices(batch, rows or max(1, batch.num_rows)):
                if (out := one(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
