"""Vector codes by active-entry Lloyd iterations.

Components become integers, vectors are cut into equal parts, and each part position has its own codebook.
A round gives every part to the nearest entry of its codebook and then moves each entry to the mean of its
parts. All is integer arithmetic, so the result does not depend on how rows are spread over tasks.

A part keeps the exact squared distance to its entry. When the entry did not move in the last round, that
distance still holds, no other unmoved entry can have become nearer, and only the moved entries are
compared with it; equal distances go to the lower index, also against the kept one. Parts whose entry
moved look at the whole codebook again.

The rows travel as blocks: one Spark row holds a few thousand vectors with their codes and distances, and
the sums its parts add to each entry. A round reads the blocks written by the one before, so a lost task
repeats its blocks alone, and sends to the driver one number per codebook component and entry, which does
not grow with the rows. Blocks of the round before are removed when the next are written.

Rows whose vector is missing, empty, or holds a missing or non-finite component are left out. Repeated
rows are rows each for themselves; the first entries are the vectors of the least ids, equal ids in the
order of their components. With fewer rows than entries the codebooks are as short. An empty table gives
an empty one. Vectors whose length differs, or does not divide into the parts, are refused, as are
components whose squares would leave 64 bits. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import dropped, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components up to here keep squared distances and their sums inside 64 bits.
GREATEST = 1 << 27
#: Distinct labels whose sums go to every task; more of them are joined by a shuffle.
FEW_LABELS = 100_000
BLOCK = "vec_id array<{id}>, label array<{label}>, width int, parts binary, codes binary, distances binary, sums array<bigint>"


def finite(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad))


def floors(column: pa.ListArray, scale: int) -> np.ndarray:
    """Rows of integers floor(scale * component)."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of several lengths")
    whole = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(whole) and np.abs(whole).max() > GREATEST:
        raise ValueError(f"a component is beyond {GREATEST / scale} in size")
    return whole.astype(np.int64).reshape(len(sizes), -1)


def narrow(x: np.ndarray) -> np.ndarray:
    """The integers in two bytes if they fit, else in four."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4")


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and its squared distance."""
    best, code = np.full(len(part), np.iinfo(np.int64).max), np.zeros(len(part), np.uint8)
    for k, entry in enumerate(book):
        distance = ((part - entry) ** 2).sum(1)
        nearer = distance < best
        best[nearer], code[nearer] = distance[nearer], k
    return code, best


def renewed(part: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and distance after the entries in ``moved`` (a flag for each) have changed."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    if lost.any():
        code[lost], distance[lost] = nearest(part[lost], book)
    kept = np.flatnonzero(~lost)
    if len(kept):
        rows, best, own = part[kept], distance[kept], code[kept]
        for k in np.flatnonzero(moved):
            found = ((rows - book[k]) ** 2).sum(1)
            nearer = (found < best) | ((found == best) & (k < own))
            best[nearer], own[nearer] = found[nearer], k
        code[kept], distance[kept] = own, best
    return code, distance


def added(parts: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """For each part position and entry: how many parts it has and their sums by component."""
    n, positions, width = parts.shape
    out = np.zeros((positions, entries, width + 1), np.int64)
    for p in range(positions):
        out[p, :, 0] = np.bincount(codes[:, p], minlength=entries)
        order = np.argsort(codes[:, p], kind="stable")
        starts = np.flatnonzero(np.diff(codes[order, p], prepend=-1))
        if n:
            out[p, codes[order, p][starts], 1:] = np.add.reduceat(parts[order, p], starts, axis=0)
    return out


class Books:
    """The codebooks: ``entries[position, entry]`` are component rows; ``moved`` flags those the last round changed."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries, self.moved = entries, moved

    def after(self, sums: np.ndarray) -> Books:
        """Each entry at the floored mean of its parts; entries without any stay."""
        count, total = sums[:, :, :1], sums[:, :, 1:]
        entries = np.where(count > 0, total // np.maximum(count, 1), self.entries)
        return Books(entries, (entries != self.entries).any(2))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def blocks_of(rows: DataFrame, scale: int, parts: int, size: int, schema: str) -> DataFrame:
    """The rows in blocks, still without codes."""
    id_type, label_type = (f.dataType for f in rows.schema.fields[:2])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                cut = batch.slice(a, size)
                vectors = pa.concat_arrays([cut.column(2)])
                found = floors(vectors, scale)
                if found.shape[1] % parts:
                    raise ValueError(f"vectors of {found.shape[1]} components do not divide into {parts} parts")
                ends = pa.array([0, cut.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.concat_arrays([cut.column(k)])) for k in (0, 1)]
                columns += [pa.array([found.shape[1]], pa.int32()), pa.array([narrow(found).tobytes()]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "width", "parts", "codes", "distances", "sums"])

    return rows.mapInArrow(run, schema.format(id=id_type.simpleString(), label=label_type.simpleString()))


def assigned(blocks: DataFrame, books: Books, parts: int) -> DataFrame:
    """The blocks with codes, distances and sums for these codebooks."""
    model = blocks.sparkSession.sparkContext.broadcast((books.entries, books.moved))
    entries_each = books.entries.shape[1]

    def run(batches):
        entries, moved = model.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                n = len(row["vec_id"])
                if row["width"] != entries.shape[0] * entries.shape[2]:
                    raise ValueError("vectors of several lengths")
                kind = "<i2" if len(row["parts"]) == 2 * n * row["width"] else "<i4"
                vectors = np.frombuffer(row["parts"], kind).astype(np.int64).reshape(n, parts, -1)
                codes, distances = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
                first = row["codes"] is None
                if not first:
                    codes[:] = np.frombuffer(row["codes"], np.uint8).reshape(n, parts)
                    distances[:] = np.frombuffer(row["distances"], "<i8").reshape(n, parts)
                for p in range(parts):
                    if first:
                        codes[:, p], distances[:, p] = nearest(vectors[:, p], entries[p])
                    else:
                        codes[:, p], distances[:, p] = renewed(vectors[:, p], entries[p], moved[p], codes[:, p], distances[:, p])
                row |= {"codes": codes.tobytes(), "distances": distances.tobytes(), "sums": added(vectors, codes, entries_each).ravel()}
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return blocks.mapInArrow(run, blocks.schema)


def summed(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The blocks' sums added up: one row per component of the codebooks."""
    found = blocks.select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(shape[0] * shape[1] * shape[2], np.int64)
    for r in found:
        out[r["place"]] = r["x"]
    return out.reshape(shape)


def compress(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """``vec_id``, ``label``, ``code`` (array of indexes) and ``error`` of every kept row, and the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = finite(df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")), "vector")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    label_type = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label_type}, code array<smallint>, error bigint"
    if not first:
        return df.sparkSession.createDataFrame([], schema), Books(np.zeros((parts, 0, 0), np.int64))
    start = floors(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale)
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components do not divide into {parts} parts")
    books = Books(start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    shape = (parts, len(first), start.shape[1] // parts + 1)
    blocks = blocks_of(rows, scale, parts, block_rows, BLOCK)
    before = None
    for _ in range(rounds):
        blocks = written(assigned(blocks, books, parts))
        books = books.after(summed(blocks, shape))
        dropped(before)
        before = blocks
    blocks = written(assigned(blocks, books, parts))
    dropped(before)

    def rows_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cut = batch.slice(k, 1)
                ids, labels = cut.column(0).flatten(), cut.column(1).flatten()
                codes = np.frombuffer(cut.column(2)[0].as_py(), np.uint8).astype(np.int16)
                errors = np.frombuffer(cut.column(3)[0].as_py(), "<i8").reshape(len(ids), -1).sum(1)
                ends = pa.array(np.arange(len(ids) + 1) * (len(codes) // len(ids)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.ListArray.from_arrays(ends, pa.array(codes)), pa.array(errors)], ["vec_id", "label", "code", "error"])

    out = blocks.select("vec_id", "label", "codes", "distances").mapInArrow(rows_of, schema)
    return out, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over rows of the same label, missing labels together."""
    sums = written(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same")), "left").drop("same")


def sql(table: str = "embeddings", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """The same codes, errors and codebooks in SQL, one step of the rounds after the other."""
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table} "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS part FROM kept, range({parts}) AS r(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM cut QUALIFY e < {entries})",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for k in range(rounds + 1):
        steps.append(
            f"got{k} AS (SELECT vec_id, p, any_value(part) AS part, min({distance} * {entries} + e) AS best FROM cut JOIN book{k} USING (p) GROUP BY vec_id, p)"
        )
        if k < rounds:
            mean = "list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i)"
            steps.append(f"sum{k} AS (SELECT p, best % {entries} AS e, i, CAST(sum(part[i]) AS BIGINT) AS s, count(*) AS n FROM got{k}, range(1, {width + 1}) AS r(i) GROUP BY ALL)")
            steps.append(
                f"book{k + 1} AS (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{k} AS b "
                f"LEFT JOIN (SELECT p, e, {mean} AS entry FROM sum{k} GROUP BY p, e) AS m USING (p, e))"
            )
    steps.append(
        f"coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM got{rounds} GROUP BY vec_id)"
    )
    books = f"(SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds})"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"{books} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
    )
