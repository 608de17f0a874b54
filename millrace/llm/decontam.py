"""Benchmark decontamination by CGK embedding and bit sampling.

Texts and benchmark items become sequences of words (lower-cased, ASCII punctuation and white space cut
words). A document holds an item if some window of its words is within ``floor(ratio * n)`` word edits
of the item's n words.

The CGK embedding walks through a sequence: at each step it writes the current word and moves on or
stays, as a random bit of that step and word says. Sequences a few edits apart then agree in most steps,
which turns edit distance into Hamming distance. Sampling a few steps gives a key; equal keys make a
candidate. Every place of a document begins an item-sized window, and every place of an item an anchor,
so that a key covers only a short stretch and several anchors and ``WALKS * SAMPLES`` keys each give a
window its chances. Items under ``SHORT`` words leave a walk few anchors; they are also cut into one
piece more than they may have edits, so that one piece is left whole, and a piece's words are a key too:
no such item is missed. The first steps of a walk never leave a window of as many words, so
one walk serves windows of all sizes. Candidates are verified by the exact edit distance.

Items of the same words are one class, looked for once. Classes are written to the shared folder in blocks
of bounded size; tasks read them from there, block after block for a run of documents, so the documents
are scanned once and never shuffled, and nothing of the benchmark passes through the driver. Candidates
are worked off in runs of bounded size, however long a text and however many items share a passage.

A missing or empty text holds nothing, an item without words is held by nothing; repeated documents and
items, also under one id or none, give a row for each pair. An empty table on either side gives an empty
result. Of the documents ``find`` reads only the id and the text; ``keep_clean`` judges each row by its
own text and keeps all its columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import ascii_lower, read_table, shared_folder, utf8, written
from millrace.llm.minhash import mixed, word_codes

RATIO = 0.2
WALKS, SAMPLES, DRAWN = 3, 2, 5
#: Items of fewer words are also found by their pieces, of which the first PIECE words count.
SHORT, PIECE = 32, 5
#: Steps of a walk by the words an item has at least.
STEPS = (16, 8, 4, 2, 1)
SEED = 7_919
#: Bytes of items in a block, and of documents that go through the blocks together.
BLOCK_BYTES, RUN_BYTES = 8 << 20, 32 << 20
#: Windows looked up together, and candidates held before they are verified.
RUN_STARTS, RUN_CANDIDATES = 1 << 17, 1 << 20
FOUND = "class_id bigint, distance int, item_words int, start_word int, end_word int"

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + PUNCTUATION, bytes(range(97, 123)) + b" " * len(PUNCTUATION))


def word_sequence(text: bytes) -> np.ndarray:
    words = text.translate(PLAIN).split()
    return np.fromiter(map(word_codes().__getitem__, words), np.uint64, len(words))


def plan(steps: int) -> list[list[np.ndarray]]:
    """For each walk the sampled steps of each key: one from each of DRAWN stretches."""
    draw = np.random.default_rng([SEED, steps])
    edges = np.linspace(0, steps, min(DRAWN, steps) + 1).astype(int)
    return [[np.array([draw.integers(a, b) for a, b in zip(edges, edges[1:])]) for _ in range(SAMPLES)] for _ in range(WALKS)]


def embedded(sequence: np.ndarray, starts: np.ndarray, steps: int) -> list[np.ndarray]:
    """A key for each start, for every walk and sample. ``sequence`` goes on for ``steps`` words after each start."""
    keys = []
    for walk, samples in enumerate(plan(steps)):
        bits = mixed(sequence * np.uint64(2 * walk + 3) + np.uint64(SEED + walk))
        at, sums = starts.copy(), [np.zeros(len(starts), np.uint64) for _ in samples]
        for step in range(1 + max(int(s.max()) for s in samples)):
            for total, sample in zip(sums, samples):
                if step in sample:
                    total *= np.uint64(0x9E3779B97F4A7C15)
                    total += sequence[at]
            at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        keys += [mixed(x) for x in sums]
    return keys


def piece_keys(sequence: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A key of the ``length`` words from each start."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + sequence[starts + k]
    return mixed(total)


def pieces(n: int, ratio: float) -> list[tuple[int, int]]:
    """Start and counted words of the pieces of a short item of n words; none if it must match as it is."""
    edits = int(ratio * n)
    if not 0 < edits < n or n >= SHORT:
        return []
    edges = np.linspace(0, n, edits + 2).astype(int).tolist()
    return [(a, min(b - a, PIECE)) for a, b in zip(edges, edges[1:])]


def table(keys: np.ndarray, item: np.ndarray, anchor: np.ndarray) -> tuple:
    order = np.argsort(keys)
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    return seen, keys[order], item[order], anchor[order]


class Index:
    """Keys of the anchors and pieces of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], ratio: float = RATIO):
        self.ids = [i for i, _ in items]
        self.words = [word_sequence(x) for _, x in items]
        self.lists = [w.tolist() for w in self.words]
        self.tiers, self.pieces = {}, {}
        if not any(map(len, self.words)):
            return
        joined = np.concatenate(self.words)
        begin = np.cumsum([0, *map(len, self.words)])
        for steps in STEPS:
            above = min((s for s in STEPS if s > steps), default=math.inf)
            chosen = [(k, a) for k, w in enumerate(self.words) if steps <= len(w) < above for a in range(len(w) - steps + 1)]
            if chosen:
                item, anchor = np.array(chosen).T
                self.tiers[steps] = [table(keys, item, anchor) for keys in embedded(joined, begin[item] + anchor, steps)]
        cut = [(k, a, n) for k, w in enumerate(self.words) for a, n in pieces(len(w), ratio)]
        for length in sorted({n for *_, n in cut}):
            item, anchor = np.array([(k, a) for k, a, n in cut if n == length]).T
            self.pieces[length] = table(piece_keys(joined, begin[item] + anchor, length), item, anchor)

    def candidates(self, sequence: np.ndarray, starts: np.ndarray):
        """(place, item, anchor) arrays of all key matches, a bounded number at a time; ``sequence`` is padded."""
        both = [x for steps, tables in self.tiers.items() for x in zip(embedded(sequence, starts, steps), tables)]
        both += [(piece_keys(sequence, starts, length), known) for length, known in self.pieces.items()]
        for keys, (seen, known, item, anchor) in both:
            maybe = np.flatnonzero(seen[(keys >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(known, keys[maybe], "left")
            n = np.searchsorted(known, keys[maybe], "right") - low
            maybe, low, n = maybe[n > 0], low[n > 0], n[n > 0]
            run = np.cumsum(n) // RUN_CANDIDATES
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(run)) + 1):
                hit = np.repeat(part, n[part])
                entry = np.repeat(low[part], n[part]) + np.arange(len(hit)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                yield np.column_stack([starts[maybe[hit]], item[entry], anchor[entry]])


def best_end(item: list[int], window: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a part of the window, and the first end of such a part. Bit-parallel over the item."""
    n = len(item)
    marks: dict[int, int] = {}
    for k, w in enumerate(item):
        marks[w] = marks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, distance = full, 0, n
    best = (n, 0)
    for at, w in enumerate(window, 1):
        match = marks.get(w, 0)
        vertical = match | down
        across = (((match & up) + up) ^ up) | match
        rise, fall = down | (full & ~(across | up)), up & across
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if distance < best[0]:
            best = (distance, at)
    return best


def verified(item: list[int], sequence: np.ndarray, at: int, most: int) -> tuple[int, int, int] | None:
    """Distance, start and end of the best part of the sequence near ``at``, if within ``most`` edits."""
    a = max(0, at - most)
    window = sequence[a : max(0, at + len(item) + most)].tolist()
    if len(set(item).difference(window)) > most:
        return None
    distance, end = best_end(item, window)
    if distance > most:
        return None
    end += a
    _, back = best_end(item[::-1], sequence[max(0, end - len(item) - most) : end][::-1].tolist())
    return distance, end - back, end


def held(texts: list[bytes], index: Index, ratio: float):
    """(text number, item, distance, start, end) of the best hit of each item in each text."""
    pad = np.zeros(max(STEPS[0], PIECE), np.uint64)
    sequences = [word_sequence(x) for x in texts]
    lengths = np.array([len(s) for s in sequences])
    joined = np.concatenate([p for s in sequences for p in (s, pad)])
    begin = np.cumsum(lengths + len(pad)) - lengths - len(pad)
    starts = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, lengths)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def verify(found: list[np.ndarray]) -> None:
        places = np.concatenate(found)
        text = np.searchsorted(begin, places[:, 0], "right") - 1
        for t, k, at in np.unique(np.column_stack([text, places[:, 1], places[:, 0] - begin[text] - places[:, 2]]), axis=0).tolist():
            item = index.lists[k]
            if hit := verified(item, sequences[t], at, int(ratio * len(item))):
                best[t, k] = min(best.get((t, k), hit), hit)

    for a in range(0, len(starts), RUN_STARTS):
        run, open_, n = starts[a : a + RUN_STARTS], [], 0
        for found in index.candidates(joined[run[0] : run[-1] + len(pad) + 1], run - run[0]):
            open_.append(found + [run[0], 0, 0])
            n += len(found)
            if n >= RUN_CANDIDATES:
                verify(open_)
                open_, n = [], 0
        if n:
            verify(open_)
    return [(t, k, *hit) for (t, k), hit in best.items()]


def normal(text: Column) -> Column:
    """The words of an item with one blank between them; items of one such text are one class."""
    marks = "".join(f"\\x{{{c:x}}}" for c in PUNCTUATION)
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"[{marks} \\t\\n\\x0B\\f\\r]+", " "))


@lru_cache(1)
def stored_index(folder: str, ratio: float) -> Index:
    """The index of a block, read from the shared folder inside a task. The last one is kept."""
    block = read_table(folder)
    return Index(list(zip(block.column("class_id").to_pylist(), utf8(block, "words"))), ratio)


class Blocks:
    """Classes of items in the shared folder: ``classes`` (class_id, words) and a folder for each block."""

    def __init__(self, items: DataFrame, ratio: float):
        """``items`` has a column ``words``."""
        self.ratio = ratio
        self.classes = written(items.where("words <> ''").select("words").distinct().withColumn("class_id", F.monotonically_increasing_id()))
        size = self.classes.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        cuts = math.ceil(size / BLOCK_BYTES)
        root = shared_folder(items.sparkSession)
        if cuts:
            dealt = self.classes.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(cuts)))
            dealt.repartition(cuts, "block").write.partitionBy("block").parquet(root)
        # hashing may leave a block of few items without any
        present = self.classes.select(F.pmod(F.xxhash64("words"), F.lit(max(cuts, 1))).alias("block")).distinct().collect()
        self.folders = [f"{root}/block={r['block']}" for r in sorted(present)]

    def over(self, docs: DataFrame, text_col: str, make, schema: str) -> DataFrame:
        """``make(run, hits)`` for runs of documents, each a table; hits are (row, class, distance, words, start, end)."""
        folders, ratio = self.folders, self.ratio

        def through(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(run)
            texts, hits = utf8(table, text_col), []
            for folder in folders:
                known = stored_index(folder, ratio)
                for a in range(0, len(texts), 256):
                    hits += [(a + t, known.ids[k], d, len(known.words[k]), s, e) for t, k, d, s, e in held(texts[a : a + 256], known, ratio)]
            yield from make(table, hits).to_batches()

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    run.append(batch)
                    size += batch.nbytes
                if size >= RUN_BYTES or (run and len(folders) == 1):
                    yield from through(run)
                    run, size = [], 0
            if run:
                yield from through(run)

        return docs.mapInArrow(mapped, schema)


def find_classes(docs: DataFrame, blocks: Blocks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and class of items it holds."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = [f.split()[0] for f in FOUND.split(", ")]

    def make(run: pa.Table, hits: list[tuple]) -> pa.Table:
        ids = run.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
        return pa.table([ids, *(pa.array([h[c + 1] for h in hits], t) for c, t in enumerate(kinds))], names=["doc_id", *names])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return blocks.over(chosen, "text", make, f"doc_id bigint, {FOUND}")


def find(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it holds: ``doc_id``, ``item_id``, ``distance``, ``item_words``, and the words of the document from ``start_word`` to before ``end_word``."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), normal(F.col(item_text)).alias("words"))
    blocks = Blocks(items, ratio)
    members = written(items.join(blocks.classes, "words").select("class_id", "item_id"))
    found = find_classes(docs, blocks, id_col, text_col)
    return found.join(members, "class_id").select("doc_id", "item_id", "distance", "item_words", "start_word", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    blocks = Blocks(benchmark.select(normal(F.col(item_text)).alias("words")), ratio)

    def make(run: pa.Table, hits: list[tuple]) -> pa.Table:
        clean = np.ones(run.num_rows, bool)
        clean[[h[0] for h in hits]] = False
        return run.filter(pa.array(clean))

    return blocks.over(docs, text_col, make, docs.schema)
