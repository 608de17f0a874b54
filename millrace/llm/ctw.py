"""Language-model scores: context-tree weighting over bytes, and a word-frequency base.

Each of the 255 binary decisions that name a byte has a context tree over the bytes before it, up to
``DEPTH`` back. A node keeps the Krichevsky-Trofimov estimate of the decision's bits and mixes it, half
and half, with the product over its children, so every depth takes part with the weight the data give
it. All this depends on counts alone, which come from one pass over all texts: how often each byte follows
each context in training. Every context is kept, in tables that grow with the corpus: decisions are summed
from the longest contexts up to the empty one, mixed on the way back down, and each (context, byte) gets
its log probability. The ``HOT`` most frequent ones go to every task; the others leave a text as (row,
gram, times) and meet their log probability in a join.

Texts are lower-cased (A-Z) UTF-8; the byte 255, which UTF-8 never uses, stands before and after each.
A missing or empty text is its end alone: one token, one coded byte. Repeated rows score alike and each
counts in training. Without training texts counts are zero and the model is uniform; an empty table
gives an empty one. Only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import folder_of, read_table, utf8, written

DEPTH = 4
#: Grams whose log probabilities go to every task, the most frequent ones; the rest are joined.
HOT = 1_000_000
EDGE = 255
#: Words whose counts go to every task, the most frequent ones, and the longest such word in bytes.
FREQUENT, LONGEST = 150_000, 64
#: Words a task counts before it passes the counts on.
HELD = 400_000


# ---- byte counts ----

def codes(texts: list[bytes]) -> np.ndarray:
    """For each coded byte of the texts: the DEPTH bytes before it and itself, oldest first, as one number."""
    joined, ends, _ = laid_out(texts)
    out = np.zeros(len(ends), np.uint64)
    for k in range(DEPTH, -1, -1):
        out = (out << np.uint64(8)) | joined[ends - k]
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array with DEPTH bytes 255 before each, the places of coded bytes, and where each text's begin."""
    joined = np.frombuffer(b"\xff" * DEPTH + (b"\xff" * DEPTH).join(texts) + b"\xff", np.uint8)
    coded = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(coded) - coded
    return joined, np.arange(int(coded.sum())) + np.repeat((np.arange(len(texts)) + 1) * DEPTH - np.arange(len(texts)), coded), begin


def gram_counts(docs: DataFrame) -> DataFrame:
    """``gram`` (DEPTH bytes and the byte after them), ``n`` over rows that are ``trained`` and ``total`` over all rows."""

    def run(batches):
        keys, sums = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["gram", "n", "total"])
        for batch in batches:
            trained = batch.column(0).to_pylist()
            texts = [x.lower() for x in utf8(batch)]
            for flag in (True, False):
                for part in blocks([x for x, t in zip(texts, trained) if t == flag]):
                    new, n = np.unique(codes(part), return_counts=True)
                    keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                    both = np.concatenate([sums, np.column_stack([n * flag, n])])
                    sums = np.column_stack([np.bincount(inverse, both[:, k], len(keys)).astype(np.int64) for k in (0, 1)])
                    if len(keys) > 2_000_000:
                        yield out()
                        keys, sums = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        if len(keys):
            yield out()

    counted = docs.select("trained", "text").mapInArrow(run, "gram bigint, n bigint, total bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def blocks(texts: list[bytes], most: int = 1 << 22):
    """The texts in runs of about ``most`` bytes."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


# ---- the tree ----

def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers: Stirling's series above 8, by recurrence below."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (heap order from 1) from counts of the 256 bytes per row."""
    zeros, ones = np.zeros((len(counts), 256)), np.zeros((len(counts), 256))
    level = counts.astype(np.float64)
    for bits in range(7, -1, -1):
        pair = level.reshape(len(counts), 1 << bits, 2)
        zeros[:, 1 << bits : 2 << bits], ones[:, 1 << bits : 2 << bits] = pair[:, :, 0], pair[:, :, 1]
        level = pair.sum(2)
    return zeros[:, 1:], ones[:, 1:]


class Tree:
    """The tree in memory, which tests hold ``gram_logs`` against. Kept contexts by depth, steps from context to longer context, and log10 probabilities of the next byte."""

    def __init__(self, counts: list[dict[int, np.ndarray]]):
        # counts[d]: context of d bytes (the latest lowest) -> counts of the 256 next bytes
        names = [sorted(c) for c in counts]
        first = np.cumsum([0, *map(len, names)])
        place = [{c: int(first[d]) + k for k, c in enumerate(n)} for d, n in enumerate(names)]
        total = int(first[-1])
        self.step = np.full((total, 256), -1, np.int32)  # by the byte one further back
        for d in range(1, len(names)):
            for c in names[d]:
                self.step[place[d - 1][c & ((1 << 8 * (d - 1)) - 1)], c >> 8 * (d - 1)] = place[d][c]
        self.log_p = np.zeros((total, 256), np.float32)
        self.learn(counts, names, first)

    def learn(self, counts, names, first) -> None:
        top = len(names) - 1
        weighted = np.zeros((0, 255))
        kept = []
        for d in range(top, -1, -1):
            here = np.stack([counts[d][c] for c in names[d]]) if names[d] else np.zeros((0, 256))
            zeros, ones = decisions(here)
            own = kt_log(zeros, ones)
            if d == top:
                mix, rest = np.ones_like(own), (zeros, ones)
                weighted = own
            else:
                below = self.step[first[d] : first[d + 1]]
                inside, under = np.zeros_like(here), np.zeros_like(own)
                owner, byte = np.nonzero(below >= 0)
                child = below[owner, byte] - first[d + 1]
                if len(child):
                    np.add.at(inside, owner, np.stack([counts[d + 1][c] for c in names[d + 1]])[child])
                    np.add.at(under, owner, weighted[child])
                rest = decisions(here - inside)
                under += kt_log(*rest)
                mix = 1 / (1 + np.exp(np.clip(under - own, -700, 700)))
                weighted = np.logaddexp(own, under) + np.log(0.5)
            kept.append((d, zeros, ones, mix, rest))
        # from the root down: the chance of a one on the path that ends in each context
        ratio = lambda z, o: (o + 0.5) / (z + o + 1.0)
        parent = np.full(int(first[-1]), -1, np.int64)
        owner, byte = np.nonzero(self.step >= 0)
        parent[self.step[owner, byte]] = owner
        by_depth = {d: (zeros, ones, mix, rest) for d, zeros, ones, mix, rest in kept}
        for d in range(top + 1):
            zeros, ones, mix, rest = by_depth[d]
            for a in range(0, len(zeros), 2048):
                at = slice(a, a + 2048)
                p = ratio(*(x[at] for x in rest))
                p = mix[at] * ratio(zeros[at], ones[at]) + (1 - mix[at]) * p
                up = parent[first[d] + np.arange(len(zeros))[at]]
                for e in range(d - 1, -1, -1):
                    z, o, m, _ = by_depth[e]
                    k = up - first[e]
                    p = m[k] * ratio(z[k], o[k]) + (1 - m[k]) * p
                    up = parent[up]
                self.log_p[first[d] + a : first[d] + a + len(p)] = byte_logs(p)

    def places(self, joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The deepest kept context before each place in ``ends``."""
        at = np.zeros(len(ends), np.int32)
        for k in range(1, DEPTH + 1):
            further = self.step[at, joined[ends - k]]
            alive = further >= 0
            if k > 1:
                alive &= deeper
            at = np.where(alive, further, at)
            deeper = alive
        return at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each lower-cased text."""
        joined, ends, begin = laid_out(texts)
        logs = self.log_p[self.places(joined, ends), joined[ends]]
        return np.add.reduceat(logs.astype(np.float64), begin)


def byte_logs(p: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the chances of a one at the 255 decisions."""
    level = np.zeros((len(p), 1))
    for bits in range(8):
        one = p[:, (1 << bits) - 1 : (2 << bits) - 1]
        level = np.stack([level + np.log10(1 - one), level + np.log10(one)], 2).reshape(len(p), 2 << bits)
    return level


def log_gamma_column(x: Column) -> Column:
    """``log_gamma`` as a column."""
    low = x < 8
    y = F.when(low, x + 8).otherwise(x)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.when(low, F.log(product)).otherwise(0.0)


def kt_log_column(zeros: Column, ones: Column) -> Column:
    return log_gamma_column(zeros + 0.5) + log_gamma_column(ones + 0.5) - log_gamma_column(zeros + ones + 1.0) - float(np.log(np.pi))


def gram_logs(grams: DataFrame) -> DataFrame:
    """``gram``, ``total`` and ``log_p``, the log10 probability of the gram's last byte after the others, from ``gram_counts``.

    A key is a context and one of the 255 decisions in heap order, the decision lowest. A context has at
    most 256 longer ones, so no key of a join has many rows.
    """
    parted = grams.select("gram", "total", F.shiftrightunsigned("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("byte"), "n")
    decided = parted.select("context", "byte", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level"))
    bit = F.expr("shiftright(byte, 7 - level) & 1")
    zeros, ones = (F.sum(F.when(bit == k, F.col("n")).otherwise(0)) for k in (0, 1))
    key = F.expr("shiftleft(context, 8) | shiftleft(1, level) | shiftright(byte, 8 - level)")
    above = lambda d: F.col("key").bitwiseAND(F.lit((1 << 8 * d + 8) - 1))
    own = kt_log_column(F.col("zeros"), F.col("ones"))
    # from the longest contexts to the empty one: a context's weighted probability, and the weight of its own estimate
    tables = [decided.groupBy(key.alias("key")).agg(zeros.alias("zeros"), ones.alias("ones")).select("*", own.alias("weighted"), F.lit(1.0).alias("mix"))]
    tables[0] = written(tables[0])
    for d in range(DEPTH - 1, -1, -1):
        here = tables[0].groupBy(above(d).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("under"))
        here = here.withColumn("own", own)
        gap = F.col("under") - F.col("own")
        weighted = F.greatest("own", "under") + F.log1p(F.exp(-F.abs(gap))) + float(np.log(0.5))
        mix = 1 / (1 + F.exp(F.least(F.greatest(gap, F.lit(-700.0)), F.lit(700.0))))
        tables.insert(0, written(here.select("key", "zeros", "ones", weighted.alias("weighted"), mix.alias("mix"))))
    # and back: the chance of a one, and the weight left to longer contexts
    down = None
    for d, table in enumerate(tables):
        share = F.col("mix") * (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
        if down is None:
            down = table.select("key", share.alias("one"), (1 - F.col("mix")).alias("left"))
            continue
        before = down.select(F.col("key").alias("parent"), F.col("one").alias("one_before"), F.col("left").alias("left_before"))
        met = table.join(before, above(d - 1) == F.col("parent"))
        # written level by level: each plan holds one join
        down = written(met.select("key", (F.col("one_before") + F.col("left_before") * share).alias("one"), (F.col("left_before") * (1 - F.col("mix"))).alias("left")))
    chances = down.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(255).cast("int").alias("node"), "one"))).alias("ones"))

    def step(level: int) -> Column:
        one = F.element_at("ones", F.expr(f"cast(shiftleft(1, {level}) | shiftright(byte, {8 - level}) as int)"))
        return F.log10(F.when(F.expr(f"shiftright(byte, {7 - level}) & 1") == 1, one).otherwise(1 - one))

    return parted.join(chances, "context").select("gram", "total", sum((step(k) for k in range(1, 8)), step(0)).alias("log_p"))


def hottest(counted: DataFrame, most: int, by: str = "total") -> Column:
    """A condition on the count ``by`` that the most frequent rows fulfil, at most so many."""
    size = F.floor(F.log2(by) * 8)
    least, held = None, 0
    for r in counted.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundred rows
        held += r["count"]
        if held > most:
            break
        least = r["size"]
    return F.lit(False) if least is None else size >= least


class Known:
    """Log probabilities of the hottest grams."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        grams = grams.astype(np.int64).view(np.uint64)
        order = np.argsort(grams)
        self.grams, self.logs = grams[order], logs[order].astype(np.float64)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each lower-cased text the sum over its known grams, its other grams, and how often it has each of those."""
        found = codes(texts)
        _, _, begin = laid_out(texts)
        own, inverse = np.unique(found, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, own), max(0, len(self.grams) - 1))
        known = self.grams[at] == own if len(self.grams) else np.zeros(len(own), bool)
        logs = np.zeros(len(own))
        logs[known] = self.logs[at[known]]
        rare = np.flatnonzero(~known[inverse])
        text = np.searchsorted(begin, rare, "right") - 1
        pairs, times = np.unique(text << 32 | inverse[rare], return_counts=True)
        offsets = pa.array(np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)), pa.int32())
        grams = pa.array(own.view(np.int64)[pairs & 0xFFFFFFFF])
        return np.add.reduceat(logs[inverse], begin), pa.ListArray.from_arrays(offsets, grams), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))


@lru_cache(2)
def hot_grams(folder: str | None) -> Known:
    """The hottest grams, read once per worker process; none where nothing was written."""
    if folder is None:
        return Known(np.empty(0, np.int64), np.empty(0))
    found = read_table(folder)
    return Known(found.column("gram").to_numpy(), found.column("log_p").to_numpy())


# ---- words ----

@lru_cache(2)
def frequent_words(folder: str | None, base: float) -> dict[bytes, tuple[float, int]]:
    """The frequent words with their log probability, read once per worker process."""
    if folder is None:
        return {}
    found = read_table(folder)
    logs = np.log10((found.column("n").to_numpy() + 0.5) / base)
    return dict(zip(found.column("word").to_pylist(), zip(logs.tolist(), [1] * len(logs))))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all rows; a task passes on sums, not single words."""

    def run(batches):
        sums: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for x in utf8(batch):
                sums.update(x.lower().split())
                if len(sums) >= HELD:
                    yield out()
                    sums = Counter()
        if sums:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows, learned from those where ``trained_on`` (a condition on ``doc_id``) holds.

    ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``. Words outside
    the frequent ones, and grams that are not hot, leave the text as (row, word, times) rows, meet their counts in a join and
    come back as sums per row: rows are numbered when they are written, so an id may occur in several.
    """
    named = docs if id_col == "doc_id" else docs.withColumn("doc_id", F.col(id_col))
    rows = named.select("doc_id", F.col(text_col).alias("text"), F.coalesce(trained_on, F.lit(False)).alias("trained"))
    training = rows.where("trained")
    counted = written(word_counts(training))
    ends, = training.agg(F.count(F.lit(1))).first()
    words, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = words + ends, distinct + (ends > 0)
    base = total + 0.5 * (kinds + 1)
    short = counted.where(F.length("word") <= LONGEST)
    # no sort and no collect: tasks read the tables from the shared folder
    frequent = folder_of(written(short.where(hottest(short, FREQUENT, "n"))))
    end = float(np.log10((ends + 0.5) / base))
    grams = written(gram_logs(written(gram_counts(rows))))
    hot = hottest(grams, HOT)
    near_by = folder_of(written(grams.where(hot).select("gram", "log_p")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        near, known = hot_grams(near_by), frequent_words(frequent, float(base))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [x.lower() for x in utf8(part)]
                sums = [near.scores(run) for run in blocks(texts)]
                scores = np.concatenate([x[0] for x in sums])
                rare_grams, gram_times = (pa.concat_arrays([x[k] for x in sums]) for k in (1, 2))
                n_tokens, known_sum, known_n, rare_words, rare_times = [], [], [], [], []
                for x in texts:
                    found = x.split()
                    logs = list(map(known.get, found))
                    n = logs.count(None)
                    n_tokens.append(len(found) + 1)
                    known_n.append(len(found) - n)
                    known_sum.append(sum(v[0] for v in logs if v))
                    rare = Counter(w for w, v in zip(found, logs) if v is None) if n else {}
                    rare_words.append(list(rare)), rare_times.append(list(rare.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(known_n, pa.int64()), pa.array(known_sum, pa.float64()), pa.array(scores), rare_grams, gram_times, pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_times, pa.list_(pa.int32()))],
                    ["doc_id", "n_tokens", "known", "known_sum", "score", "grams", "gram_times", "words", "times"],
                )

    done = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, known bigint, known_sum double, score double, grams array<bigint>, gram_times array<int>, words array<binary>, times array<int>")
    done = written(done.withColumn("row", F.monotonically_increasing_id()))
    rare = done.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counted, "word", "left")
    log = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(float(base)))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * log).alias("rare_sum"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"))
    apart = done.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    logs = apart.join(grams.where(~hot), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("rare_score"))
    out = done.drop("words", "times", "grams", "gram_times").join(sums, "row", "left").join(logs, "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return out.select(
        "doc_id", "n_tokens",
        (F.col("known") + zero("rare_known") + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("known_sum") + zero("rare_sum") + F.lit(end)).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )
