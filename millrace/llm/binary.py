"""Token ids as flat binary files.

Layout of a folder, all numbers little-endian:

* ``part-NNNNN.bin``: the ids of consecutive documents without gaps, unsigned, 2 bytes each if the
  vocabulary fits, else 4
* ``part-NNNNN.idx``: the documents' ids, then their n + 1 offsets within the part, as 64-bit integers
* a manifest table (Parquet, folder ``manifest``): part, file stem, documents, ids, bytes per id and
  ``base``, the number of ids in all earlier parts

Parts hold ascending ranges of ``doc_id``. A task writes under a name of its own and renames when
done, so a retried task leaves the same files. Bases are prefix sums over the manifest, one row per part.

A missing or empty text is the end id alone; rows that repeat an id lie side by side, in any order; an
empty table gives no parts. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.llm.common import over_batches, place, shared_folder, strings
from millrace.llm.tokens import encoder

MANIFEST = "part int, stem string, n_docs bigint, n_ids bigint, id_bytes int"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the documents into files below ``folder`` and return the manifest."""
    spark = docs.sparkSession
    files, path = place(folder)
    files.create_dir(path)

    def write(batches):
        files, path = place(folder)
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], encode.dtype).tobytes()
        ids, lengths, stem = [], [], f"part-{part:05d}"
        own = f"{path}/.{stem}-{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            out = out or files.open_output_stream(f"{own}.bin")
            for i, found in zip(batch.column(0).to_pylist(), encode.many(strings(batch))):
                found += end
                out.write(found)
                ids.append(i), lengths.append(len(found) // encode.dtype.itemsize)
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{own}.idx") as index:
            index.write(np.array(ids, "<i8").tobytes())
            index.write(np.cumsum([0, *lengths]).astype("<i8").tobytes())
        for end in ("bin", "idx"):
            files.move(f"{own}.{end}", f"{path}/{stem}.{end}")
        row = [[part], [stem], [len(ids)], [sum(lengths)], [encode.dtype.itemsize]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], ["part", "stem", "n_docs", "n_ids", "id_bytes"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/written")
    parts = spark.read.schema(MANIFEST).parquet(f"{folder}/written")
    # one short row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST + ", base bigint").parquet(f"{folder}/manifest")


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped if it is local, else read."""
    files, path = place(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with files.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as 32-bit numbers)."""
    manifest = spark.read.schema(MANIFEST + ", base bigint").parquet(f"{folder}/manifest").drop("part", "n_ids")
    n = max(1, min(manifest.count(), 100_000))

    def make():
        def one(batch):
            out = []
            for stem, n_docs, width, base in zip(*(c.to_pylist() for c in batch.columns)):
                index, ids = mapped(folder, f"{stem}.idx", "<i8"), mapped(folder, f"{stem}.bin", f"<u{width}")
                doc, at = index[:n_docs], index[n_docs:]
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.array(doc)), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return one

    return over_batches(manifest.repartition(n), make, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the documents to a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession)
    write_tokens(docs, tokenizer, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
