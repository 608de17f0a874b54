"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. Each text becomes its set of word shingles; texts with equal sets form a class, found by a 128-bit
   digest, and only the class's least document goes on.
2. 128 minima of a class give 32 band keys of four minima each, and their low four bits, packed, are the
   signature. Agreeing positions of two signatures, counted bitwise and corrected for chance, estimate
   the similarity; pairs far below the threshold (more than five standard errors) need no exact check.
3. First round: in every bucket of a band each member is compared with three leads (the least by three
   hashes). Whatever is confirmed on the full sets links the members, and connected components are found
   by passing on least ids, with every round written to the shared folder.
4. Second round: in buckets that still hold several components, members of different ones are compared
   block by block. Each brings the least ``CARRIED`` codes of its set along. Where that is the whole set
   the pair is decided on the spot; otherwise these codes estimate the similarity once more, and each
   member's likeliest partners are confirmed on the texts. A block returns no more links than join its
   components.
5. Third round: the same for pairs with a larger set that are still apart, all of them, so that no link
   between different texts is lost. Blocks hold a bounded number of rows of bounded size.

A pair of similarity s shares a band with probability 1 - (1 - s^4)^32: all but 5e-8 at 0.8.

Texts are lower-cased (A-Z) and cut into words at ASCII white space. With fewer words than a shingle has,
the whole sequence is one shingle; without words, or without a text, a document is linked with nothing.
Repeated rows (the same id) count once. An empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import over_batches, utf8, written

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
LEADS = 3
BLOCK = 1024
#: Codes of a set that go into a block.
CARRIED = 512
#: Rows a task turns into texts and sets at once, and pairs of texts.
AT_ONCE = 500
SEED = 20_240


class Words(dict):
    """64-bit codes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = code
        return code


@lru_cache(1)
def word_codes() -> Words:
    return Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit codes of a text's shingles."""
    words = text.lower().split()
    codes = np.fromiter(map(word_codes().__getitem__, words), np.uint64, len(words))
    if not len(codes):
        return codes
    n = max(1, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(codes))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(out)


@lru_cache(1)
def factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(codes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    a, b = factors()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (codes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        y = x[None, k : k + 4096] * a[:, None] + b[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        low = np.minimum(low, y.min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The low bits of the minima, bit plane after bit plane."""
    return b"".join(np.packbits((low >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(BITS))


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of signatures (rows of bit planes as 64-bit words), corrected for chance agreement."""
    differ = (left ^ right).reshape(*np.broadcast_shapes(left.shape, right.shape)[:-1], BITS, HASHES // 64)
    agree = 1 - np.bitwise_count(np.bitwise_or.reduce(differ, -2)).sum(-1) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard errors below the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set, ``sig`` and ``keys`` (both NULL for empty sets)."""

    def make():
        def one(batch):
            n, digest, sig, keys = [], [], [], []
            for x in utf8(batch):
                codes = shingle_set(x, size)
                n.append(len(codes))
                if len(codes):
                    low = minima(codes)
                    digest.append(xxhash.xxh3_128_digest(codes.tobytes())), sig.append(packed(low)), keys.append(band_keys(low))
                else:
                    digest.append(None), sig.append(None), keys.append(None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "keys"])

        return one

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return over_batches(chosen, make, "doc_id bigint, n_shingles bigint, digest binary, sig binary, keys array<bigint>", AT_ONCE)


def near(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, sa, na, b, sb, nb) whose signatures agree well enough and whose sizes allow a link, as (a, b) with a < b."""
    least = least_estimate(threshold)

    def make():
        def one(batch):
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (1, 3))
            good = estimates(left, right) >= least
            a, b = batch.column(0).to_numpy()[good], batch.column(2).to_numpy()[good]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        return one

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(threshold * 100)
    return over_batches(pairs.where(fits).select("a", "sa", "b", "sb"), make, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    parts, whole = round(threshold * 100), 100

    def make():
        sets: dict[int, np.ndarray] = {}

        def found(i: int, text: bytes) -> np.ndarray:
            if i not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[i] = shingle_set(text, size)
            return sets[i]

        def one(batch):
            good = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "ta"), utf8(batch, "tb")):
                x, y = found(a, ta), shingle_set(tb, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(whole * both >= parts * (len(x) + len(y) - both))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return one

    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return over_batches(met.select("a", "b", "ta", "tb"), make, "a bigint, b bigint", AT_ONCE)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``least``: the least node each linked node can reach.

    Every round takes the least neighbour's label and the label of the own label, so long chains take a
    logarithmic number of rounds.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least")))
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "to"}), "to").groupBy("node").agg(F.min("least").alias("near"))
        step = labels.join(seen, "node").select("node", "least", F.least("least", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("least").alias("far"))
        step = written(step.join(jump, "next", "left").select("node", "least", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = step.select("node", F.col("next").alias("least"))
        if step.where("least <> next").isEmpty():
            return labels


def carried(texts: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``rep`` and ``codes``, the least codes of the set, for the texts named in ``chosen``."""

    def make():
        def one(batch):
            codes = [shingle_set(x, size)[:CARRIED].tobytes() for x in utf8(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["rep", "codes"])

        return one

    named = texts.withColumnRenamed("doc_id", "rep").join(chosen, "rep")
    return over_batches(named.select("rep", "text"), make, "rep bigint, codes binary", AT_ONCE).dropDuplicates(["rep"])


def blocks_apart(members: DataFrame, threshold: float, again: bool) -> DataFrame:
    """Pairs of different components within buckets, from rows (key, rep, comp, sig, keys, n, codes).

    Buckets are cut into blocks of about BLOCK rows and blocks are paired. A pair that shares several
    bands is compared in the first of them only. Rows (a, b, sure): pairs of whole sets come out as sure
    links, as many as join the block's components; of the others come those that may be links, at first
    LEADS for each member. ``again`` leaves out pairs of whole sets and returns all others.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    cut = members.join(sizes, "key").withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    # block x meets block y once, as (lower, upper)
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("cut")).alias("lower"), F.greatest(k, F.col("cut")).alias("upper")))
    dealt = cut.select("key", "rep", "comp", "sig", "keys", "n", "codes", "cut", F.explode(pairs).alias("pair"))
    least, parts = least_estimate(threshold), round(threshold * 100)
    least_share = threshold - 5 * (threshold * (1 - threshold) / CARRIED) ** 0.5

    def one(table: pa.Table) -> pa.Table:
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        label = table.column("comp").to_numpy().copy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(rep), -1)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), BANDS)
        band = int(np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0])
        codes = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
        known, place = np.unique(np.concatenate(codes), return_inverse=True)
        place = np.split(place, np.cumsum([len(x) for x in codes])[:-1])
        whole, marked = n <= CARRIED, np.zeros(len(known), bool)
        side = table.column("cut").to_numpy()
        lower, upper = table.column("pair")[0].as_py().values()
        rows, cols = (np.flatnonzero(side == lower), np.flatnonzero(side == upper))
        links, open_pairs = [], []
        for k in rows.tolist():
            far = cols[label[cols] != label[k]]
            if lower == upper:
                far = far[rep[far] > rep[k]]
            if again:
                far = far[~(whole[far] & whole[k])]
            far = far[100 * np.minimum(n[far], n[k]) >= parts * np.maximum(n[far], n[k])]
            if len(far):
                far = far[estimates(sig[k][None], sig[far]) >= least]
                far = far[(keys[far, :band] != keys[k, :band]).all(1)]
            marked[place[k]] = True
            maybe = []
            for j in far.tolist():
                if label[j] == label[k]:
                    continue
                if whole[j] and whole[k]:
                    both = np.count_nonzero(marked[place[j]])
                    if 100 * both >= parts * (n[j] + n[k] - both):
                        links.append((k, j))
                        label[label == label[j]] = label[k]
                else:
                    least_codes = np.union1d(place[k], place[j])[:CARRIED]
                    share = np.count_nonzero(marked[place[j]] & (place[j] <= least_codes[-1])) / len(least_codes)
                    if share >= least_share:
                        maybe.append((share, j))
            marked[place[k]] = False
            open_pairs += [(k, j) for _, j in (maybe if again else sorted(maybe, reverse=True)[:LEADS])]
        open_pairs = [(k, j) for k, j in open_pairs if label[k] != label[j]]
        k, j = np.array(links + open_pairs, np.int64).reshape(-1, 2).T
        sure = np.arange(len(k)) < len(links)
        return pa.table({"a": np.minimum(rep[k], rep[j]), "b": np.maximum(rep[k], rep[j]), "sure": sure})

    return dealt.groupBy("key", "pair").applyInArrow(one, "a bigint, b bigint, sure boolean").distinct()


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links of at least ``threshold``."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(texts, size))
    own = signed.select("doc_id", "n_shingles", "digest")
    first = own.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(first.join(signed.select("doc_id", "sig", "keys", F.col("n_shingles").alias("n")), F.col("rep") == F.col("doc_id")).select("rep", "sig", "keys", "n").dropDuplicates(["rep"]))
    spread = reps.select("rep", F.explode("keys").alias("key"))
    order = lambda k: F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), F.col("rep"))
    leads = F.array(F.min("rep"), *(F.min(order(k))["rep"] for k in range(1, LEADS)))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(leads).alias("leads")).where("n > 1").drop("n")
    met = written(spread.join(shared, "key"))
    pairs = met.select("rep", F.explode("leads").alias("lead")).where("rep <> lead").distinct()
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    pairs = pairs.select(F.col("lead").alias("a"), F.col("rep").alias("b")).join(right, "b").join(left, "a")
    links = written(confirmed(near(pairs, threshold), texts, size, threshold))
    found = components(links)
    for again in (False, True):
        placed = met.select("rep", "key").join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("comp", F.coalesce("least", "rep")).drop("least")
        placed = written(placed.join(reps.select("rep", "n"), "rep"))
        open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("n").alias("most")).where("lo <> hi")
        rest = placed.join(open_keys.where(F.col("most") > (CARRIED if again else 0)).select("key"), "key")
        codes = written(carried(texts, rest.select("rep").distinct(), size))
        rest = rest.drop("n").join(reps, "rep").join(codes, "rep")
        apart = written(blocks_apart(rest, threshold, again))
        more = written(apart.where("sure").select("a", "b").union(confirmed(apart.where("NOT sure").select("a", "b"), texts, size, threshold)))
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b").union(more))
    reached = first.join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    return own.join(reached, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its class."""
    gone = classes(docs, size, threshold).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

