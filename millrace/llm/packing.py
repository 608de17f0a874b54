"""Sum-of-squares packing of token sequences.

Documents become ids plus an end id, and longer ones are cut into full pieces and a rest. Pieces are
dealt by a hash into groups of about ``group_rows`` and every group is packed by itself, so a task
holds a bounded number of short rows however large the table. Within a group pieces come in falling
length; each goes to the open sequence where the sum of squares of the numbers of open sequences per
gap becomes smallest, the smallest gap winning ties, and to a new one if it fits in none. A filled
sequence has no gap and counts nothing.

A missing or empty text is the end id alone. Rows that repeat are packed each for itself; an empty
table gives an empty one. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import over_batches, strings, written
from millrace.llm.tokens import encoder

CAPACITY = 2048
#: Pieces a group has on average; what is lost at the end of a group is a sequence or two.
GROUP_ROWS = 16_384
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the crc32 of its ids as unsigned 32-bit numbers."""

    def make():
        encode = encoder(tokenizer)

        def one(batch):
            doc, piece, start, length, crc = [], [], [], [], []
            end = np.array([end_id], encode.dtype).tobytes()
            for i, found in zip(batch.column(0).to_pylist(), encode.many(strings(batch))):
                ids = np.frombuffer(found + end, encode.dtype).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    doc.append(i), piece.append(k), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc, piece, start, length, crc), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return one

    return over_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), make, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a gap of 0 is not open
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(map(int, lengths)):
        # the change of the sum for each gap the piece could go to; a filled sequence adds no gap
        change = np.where(count[size:] > 0, 2 * (count[: capacity + 1 - size] - count[size:] + 1), far)
        if change[0] != far:
            change[0] -= 1
        gap = int(change.argmin()) + size
        if change[gap - size] != far:
            at = waiting[gap].pop()
            count[gap] -= 1
        else:
            at, gap, made = made, capacity, made + 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > size:
            waiting[gap - size].append(at)
            count[gap - size] += 1
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with a ``length``. Reads the table twice."""
    groups = max(1, math.ceil(parts.count() / group_rows))
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        base = np.int64(table.column("group")[0].as_py()) << np.int64(32)
        table = table.drop_columns(["group"])
        return table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(one, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Cut and pack in one call; the pieces are written once so that texts are encoded once."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id)), capacity)
