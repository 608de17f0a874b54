"""Hard negatives by bounds from segment summaries.

Components become integers floor(scale * x); a row's score for an anchor is their inner product. An
anchor's positives are its best rows of the same label; a positive's hard negatives are the best rows of
other labels whose score lies between a share of the positive's and all of it.

Every vector is stored with summaries of its segments, at several levels of refinement: the mean m and the
deviation s of a segment of L components. For a segment of two vectors the inner product lies within
L * (m m' - s s') and L * (m m' + s s') by Cauchy-Schwarz, so the sums over segments bound a score. Pairs
whose bounds miss the wanted range are dropped, the others go to the next level with shorter segments, and
what is left is scored exactly. The range is the window of the anchor's positives, raised as better rows
are found.

The anchors are the query set. They and the rows are written as blocks of a few thousand vectors; a task
takes up to ``CHUNK`` rows and goes through the anchors' blocks, read from the shared folder, so it holds
a bounded number of rows and one block. It passes on, per anchor and chunk, the best few rows, which are
merged by anchor. Nothing is dealt by label, so a hot label stays spread.

Rows whose id, label or vector is missing, or whose vector is empty or holds a missing or non-finite
component, take no part. Ties go to the smaller id. Rows that repeat an id with the same score count once;
an anchor's own id is never its positive. An anchor without positives, and a positive without a row in
its window, give no rows; so does an empty table. Vectors of several lengths are refused. Ids are
integers; columns other than id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.codes import finite, floors, narrow
from millrace.llm.common import dropped, folder_of, stored, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative scores from so many hundredths of the positive up to all of them.
LEAST, WHOLE = 80, 100
#: Segments per vector, level by level.
LEVELS = (4, 16)
#: Vectors in a stored block, anchors in one, rows a task holds, and rows scored against a block at once.
BLOCK, ANCHORS, CHUNK, TILE = 4096, 512, 1 << 18, 8192
#: Below this share of pairs left, pairs are looked at one by one instead of in whole products.
SPARSE = 0.05
#: What rounding may add to a bound, as a share of the product of the lengths.
SLACK = 1e-9


def summaries(vectors: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the root of the segment's length, so that their products add up."""
    width = vectors.shape[1]
    starts = np.unique(np.linspace(0, width, pieces + 1).astype(int)[:-1])
    lengths = np.diff(np.append(starts, width))
    mean = np.add.reduceat(vectors, starts, axis=1) / lengths
    apart = vectors - np.repeat(mean, lengths, axis=1)
    return mean * np.sqrt(lengths), np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))


@dataclass
class Vectors:
    """Vectors with their ids, labels and summaries."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    means: list[np.ndarray]
    deviations: list[np.ndarray]

    def __post_init__(self):
        self.lengths = np.sqrt((self.whole.astype(np.float64) ** 2).sum(1))
        self.most = int(np.abs(self.whole).max(initial=0))

    def at(self, rows) -> Vectors:
        return Vectors(self.ids[rows], self.labels[rows], self.whole[rows], [m[rows] for m in self.means], [d[rows] for d in self.deviations])

    @staticmethod
    def joined(parts: list[Vectors]) -> Vectors:
        if len({p.whole.shape[1] for p in parts}) > 1:
            raise ValueError("vectors of several lengths")
        levels = range(len(parts[0].means))
        return Vectors(
            np.concatenate([p.ids for p in parts]), np.concatenate([p.labels for p in parts]), np.concatenate([p.whole for p in parts]),
            [np.concatenate([p.means[k] for p in parts]) for k in levels], [np.concatenate([p.deviations[k] for p in parts]) for k in levels])


def blocks_of(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of ``size`` rows (vec_id, label, vector, others): arrays of the columns, the integers and their summaries as bytes."""
    names = [c for c in rows.columns if c != "vector"]
    place_of = rows.columns.index("vector")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} array<{kinds[n]}>" for n in names) + ", width int, whole binary, means array<binary>, deviations array<binary>"

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                cut = batch.slice(a, size)
                whole = floors(pa.concat_arrays([cut.column(place_of)]), scale)
                levels = [summaries(whole, k) for k in LEVELS]
                ends = pa.array([0, cut.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.concat_arrays([cut.column(batch.schema.get_field_index(n))])) for n in names]
                columns += [pa.array([whole.shape[1]], pa.int32()), pa.array([narrow(whole).tobytes()])]
                columns += [pa.array([[x[k].tobytes() for x in levels]], pa.list_(pa.binary())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "width", "whole", "means", "deviations"])

    return rows.mapInArrow(run, schema)


def vectors_of(batch: pa.RecordBatch | pa.Table, row: int) -> Vectors:
    """One stored block as arrays."""
    value = lambda name: batch.column(name)[row]
    ids, labels = (np.asarray(value(n).values.to_numpy(zero_copy_only=False)) for n in ("vec_id", "label"))
    data, width = value("whole").as_py(), value("width").as_py()
    whole = np.frombuffer(data, "<i2" if len(data) == 2 * len(ids) * width else "<i4").reshape(len(ids), width)
    levels = [[np.frombuffer(x, np.float64).reshape(len(ids), -1) for x in value(n).as_py()] for n in ("means", "deviations")]
    return Vectors(ids, labels, whole, *levels)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """Stored blocks put together to about ``CHUNK`` rows."""
    held: list[Vectors] = []
    for batch in batches:
        for row in range(batch.num_rows):
            held.append(vectors_of(batch, row))
            if sum(len(v.ids) for v in held) >= CHUNK:
                yield Vectors.joined(held)
                held = []
    if held:
        yield Vectors.joined(held)


def blocks_in(folder: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of a stored table, one block at a time."""
    for file in stored(folder):
        for batch in file.iter_batches(batch_size=1):
            for row in range(batch.num_rows):
                yield batch, row


def within(anchors: Vectors, rows: Vectors, least: np.ndarray, most: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) with a score from ``least`` to ``most`` of the anchor, and the scores; ``apart``: of different labels only."""
    if anchors.whole.shape[1] != rows.whole.shape[1]:
        raise ValueError("vectors of several lengths")
    left = right = None  # the pairs still possible, once they are few
    possible = np.ones((len(anchors.ids), len(rows.ids)), bool)
    for k in range(len(anchors.means)):
        if left is None:
            middle = anchors.means[k] @ rows.means[k].T
            reach = anchors.deviations[k] @ rows.deviations[k].T + SLACK * np.outer(anchors.lengths, rows.lengths)
            possible &= (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
            if np.count_nonzero(possible) < SPARSE * possible.size:
                left, right = np.nonzero(possible)
        else:
            middle = np.einsum("ij,ij->i", anchors.means[k][left], rows.means[k][right])
            reach = np.einsum("ij,ij->i", anchors.deviations[k][left], rows.deviations[k][right]) + SLACK * anchors.lengths[left] * rows.lengths[right]
            kept = (middle + reach >= least[left]) & (middle - reach <= most[left])
            left, right = left[kept], right[kept]
    # sums of products below 2^53 are exact as floating point numbers
    number = np.float64 if anchors.whole.shape[1] * anchors.most * rows.most < 1 << 53 else np.int64
    own, other = anchors.whole.astype(number), rows.whole.astype(number)
    if left is None:
        scores = own @ other.T
        possible &= (scores >= least[:, None]) & (scores <= most[:, None])
        left, right = np.nonzero(possible)
        scores = scores[left, right]
    else:
        scores = np.einsum("ij,ij->i", own[left], other[right])
        kept = (scores >= least[left]) & (scores <= most[left])
        left, right, scores = left[kept], right[kept], scores[kept]
    if apart:
        kept = anchors.labels[left] != rows.labels[right]
        left, right, scores = left[kept], right[kept], scores[kept]
    return left, right, scores.astype(np.int64)


class Best:
    """Rows found so far, by anchor, falling score and id, each (anchor, score, id) once."""

    def __init__(self):
        self.anchor, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        anchor, score, ids = np.append(self.anchor, anchor), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, anchor))
        anchor, score, ids = anchor[order], score[order], ids[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(score) != 0) | (np.diff(ids) != 0)
        self.anchor, self.score, self.id = anchor[new], score[new], ids[new]

    def keep(self, rows: np.ndarray) -> None:
        self.anchor, self.score, self.id = self.anchor[rows], self.score[rows], self.id[rows]

    def places(self, anchor: np.ndarray, top: np.ndarray, least: np.ndarray, n: int) -> np.ndarray:
        """For each (anchor, top, least): places of its first ``n`` rows that score from ``least`` to ``top``, -1 where there is none."""
        if not len(self.anchor):
            return np.full((len(anchor), n), -1)
        values, rank = np.unique(np.concatenate([self.score, top]), return_inverse=True)
        key = lambda a, r: a * (len(values) + 1) + (len(values) - r)
        first = np.searchsorted(key(self.anchor, rank[: len(self.score)]), key(anchor, rank[len(self.score) :]))
        at = first[:, None] + np.arange(n)
        inside = at < len(self.anchor)
        at = np.where(inside, at, 0)
        inside &= (self.anchor[at] == anchor[:, None]) & (self.score[at] >= least[:, None])
        return np.where(inside, at, -1)


def best_of_label(anchors: Vectors, rows: Vectors, n: int) -> Best:
    """The best ``n`` rows of the same label for each anchor, not of its id."""
    found = Best()
    everything = np.arange(len(rows.ids))
    top = np.full(len(anchors.ids), np.iinfo(np.int64).max)
    for label in np.unique(anchors.labels):
        own = np.flatnonzero(anchors.labels == label)
        same = everything[rows.labels == label]
        least = np.full(len(own), np.iinfo(np.int64).min)
        mine, few = anchors.at(own), Best()
        for a in range(0, len(same), TILE):
            tile = rows.at(same[a : a + TILE])
            left, right, scores = within(mine, tile, least, top[own], False)
            other = mine.ids[left] != tile.ids[right]
            few.add(left[other], scores[other], tile.ids[right][other])
            places = few.places(np.arange(len(own)), top[own], np.full(len(own), np.iinfo(np.int64).min), n)
            full = places[:, -1] >= 0
            least[full] = few.score[places[full, -1]]
            few.keep(np.unique(places[places >= 0]))
        found.add(own[few.anchor], few.score, few.id)
    return found


def best_in_windows(anchors: Vectors, rows: Vectors, owner: np.ndarray, top: np.ndarray, least: np.ndarray, n: int) -> tuple[Best, np.ndarray]:
    """The best ``n`` rows of other labels in each window (anchor, least to top), and their places in what is returned."""
    found = Best()
    lowest, highest = np.full(len(anchors.ids), np.iinfo(np.int64).max), np.full(len(anchors.ids), np.iinfo(np.int64).min)
    np.maximum.at(highest, owner, top)
    least_now = least.copy()
    for a in range(0, len(rows.ids), TILE):
        lowest[:] = np.iinfo(np.int64).max
        np.minimum.at(lowest, owner, least_now)
        tile = rows.at(slice(a, a + TILE))
        left, right, scores = within(anchors, tile, lowest, highest, True)
        found.add(left, scores, tile.ids[right])
        places = found.places(owner, top, least, n)
        full = places[:, -1] >= 0
        least_now[full] = found.score[places[full, -1]]
        found.keep(np.unique(places[places >= 0]))
    return found, found.places(owner, top, least, n)


def hard_negatives(df: DataFrame, anchors: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, whole: int = WHOLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``vec_id`` that names the query set.
    """
    chosen = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = finite(chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), "vector")
    blocks = written(blocks_of(rows, BLOCK, scale))
    # rows that are equal in all of this make one anchor
    asked = written(rows.where(anchors).dropDuplicates(["vec_id", "label", "vector"]).withColumn("number", F.monotonically_increasing_id()))
    first = written(blocks_of(asked, ANCHORS, scale))
    up, down = least // gcd(least, whole), whole // gcd(least, whole)
    folder = folder_of(first) if first.count() else None
    schema = "number bigint, score bigint, vec_id bigint"

    def nearest(batches):
        for some in chunks(batches):
            for batch, row in blocks_in(folder):
                few = best_of_label(vectors_of(batch, row), some, positives)
                numbers = batch.column("number")[row].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(numbers[few.anchor]), pa.array(few.score), pa.array(few.id)], ["number", "score", "vec_id"])

    def merged(found: DataFrame, n: int, *by: str) -> DataFrame:
        """The best ``n`` of what the chunks passed on, in order."""
        best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("below"), "vec_id"))), 1, n)
        return found.groupBy(*by).agg(best.alias("best"))

    spark = df.sparkSession
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if folder is None:
        return spark.createDataFrame([], empty)
    picked = merged(blocks.mapInArrow(nearest, schema), positives, "number")
    picked = picked.select("number", F.transform("best", lambda x: x["vec_id"]).alias("positive_id"), F.transform("best", lambda x: -x["below"]).alias("positive_score"))
    second = written(blocks_of(asked.join(picked, "number"), ANCHORS, scale))
    dropped(first)
    if not second.count():
        return spark.createDataFrame([], empty)
    windows = folder_of(second)

    def hard(batches):
        for some in chunks(batches):
            for batch, row in blocks_in(windows):
                own = vectors_of(batch, row)
                lists = batch.column("positive_score")[row].values
                owner = np.repeat(np.arange(len(own.ids)), np.diff(lists.offsets.to_numpy()))
                top = lists.flatten().to_numpy()
                positive = batch.column("positive_id")[row].values.flatten().to_numpy()
                # the least whole score that is least / whole of the positive's
                few, places = best_in_windows(own, some, owner, top, -(-up * top // down), negatives)
                window, nth = np.nonzero(places >= 0)
                at, numbers = places[window, nth], batch.column("number")[row].values.to_numpy()
                columns = [numbers[owner[window]], own.ids[owner[window]], positive[window], top[window], few.score[at], few.id[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "anchor_id", "positive_id", "positive_score", "score", "vec_id"])

    found = blocks.mapInArrow(hard, "number bigint, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, vec_id bigint")
    best = merged(found, negatives, "number", "anchor_id", "positive_id", "positive_score")
    return best.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "x")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.below")).alias("negative_score"))


def sql(anchor: str, label: str = "label", table: str = "embeddings") -> str:
    """The same in SQL: every anchor against every row. ``anchor`` is a condition on vec_id, ``label`` the label to use."""
    return f"""
    WITH kept AS (
      SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM {table}
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM (SELECT * FROM kept WHERE {anchor}) AS a JOIN kept AS b ON a.vec_id <> b.vec_id),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND {LEAST} * positive_score <= {WHOLE} * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY rank <= {NEGATIVES}"""
