"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams, with lower orders as back-off) and a table of word features are
   learned from all labelled texts (``max_train`` asks for fewer ids, those that hash lowest). An id counts
   once, however often its row is repeated; of different rows of one id the least (by label, then text) is taken.
2. A token that may be disguised (digits or signs between letters, a letter three times or more, single
   letters spaced out) becomes a lattice: each character may stand for itself or for letters it
   resembles, repeats may shrink to two or one, separators vanish or, in a spaced passage, end a
   word. Viterbi finds the most likely reading
   under the language model plus a price for each substitution.
3. Features of the restored words are the word itself and all its 4- to 6-character pieces; those much more
   frequent in toxic texts carry weight, and a word counts as its strongest feature. A logistic model of
   the summed weight and of the number of toxic words gives the score.

All features of all labelled texts are counted, whatever they turn out to weigh: first in the toxic texts and a
share of the others, then in the rest. A task packs the pieces of many texts into numbers and counts these.
The character model is learned from the 50,000 most frequent words of up to 48 letters.

A missing or empty text has no toxic word and scores the model's value for that. Without labels of both
kinds every score is 0. Repeated rows score alike; an empty table gives an empty one. Only id and text
are read of ``docs``; labels, language and source are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import dropped, in_slices, over_batches, strings, written

#: One in so many texts that are not toxic is counted with the toxic ones, the others after them.
FIRST_BY = 8
#: Bits of a character in a packed piece of up to six; a piece of other characters is counted as it is.
CHAR_BITS = 10
#: Letters of words whose pieces a task packs at once, and features it holds before it passes them on.
LETTERS_AT_ONCE, MOST_HELD = 400_000, 1_000_000
#: Partitions whose most frequent words reach the driver.
TOP_PARTS = 24
#: Texts a task turns into Python strings at once.
AT_ONCE = 500
THRESHOLD = 0.7
# fixed values: what a sign may stand for
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = frozenset(".-_*~'`,/\\ ")
#: Prices of a separator that vanishes and of one that ends a word.
JOIN, PART = 0.3, 0.3
WORD = re.compile(r"[^\W\d_]+")
#: A token worth decoding: a letter next to a look-alike or separator next to a letter, or a letter three times.
HIDDEN = re.compile(r"[^\W\d_][0-9@$!|+€(.\-_*~]+[^\W\d_]|[0-9@$!|+€(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+€(]+\b|([^\W\d_])\1\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Three or more single characters, or four or more of one or two, with blanks, line ends or signs between. One blank before it is part of the match.
SPACED = re.compile(r"\s(?=[^\s.,;:]{1,2}[\s.\-_*])((?:(?:[^\s.,;:]{1,2}(?:\s+|[.\-_*])){3,}[^\s.,;:]{1,2}|(?:[^\s.,;:](?:\s+|[.\-_*])){2}[^\s.,;:])(?!\S))")
EDGE = "\"'.,;:!?()[]{}<>#*%&$|+-_~`=/\\"
#: Of these, what is no look-alike before or after a word.
BEFORE = "".join(c for c in EDGE if c not in "$!|+")
AFTER = EDGE.replace("$", "")


class CharModel:
    """Trigram probabilities of characters within words, "^" before and "$" after, with two lower orders mixed in."""

    def __init__(self, words: dict[str, float]):
        grams: list[defaultdict] = [defaultdict(float) for _ in range(3)]
        bases: list[defaultdict] = [defaultdict(float) for _ in range(3)]
        for word, weight in words.items():
            text = f"^^{word}$"
            for k in range(2, len(text)):
                for n in range(3):
                    grams[n][text[k - n : k + 1]] += weight
                    bases[n][text[k - n : k]] += weight
        self.grams, self.bases = [dict(g) for g in grams], [dict(b) for b in bases]
        self.seen: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        """Minus log probability of a character after two others."""
        key = before + c
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            p = 1e-5
            for n, share in ((0, 0.1), (1, 0.25), (2, 0.65)):
                context = before[2 - n :]
                if base := self.bases[n].get(context):
                    p += share * self.grams[n].get(context + c, 0.0) / base
            self.seen[key] = -math.log(p)
        return self.seen[key]


def readings(token: str) -> Iterator[list[tuple[str, float]]]:
    """The lattice: for each run of one character the strings it may stand for, with their prices. A blank ends a word."""
    spaced = 3 * sum(map(token.count, SEPARATORS)) >= len(token) - 2
    for m in re.finditer(r"(?s)(.)\1*", token):
        c, n = m[1], m.end() - m.start()
        inside = 0 < m.start() and m.end() < len(token)
        if c.isalpha():
            ways = [(c * n, 0.0)] if n < 3 else [(c, 0.5), (c * 2, 0.5)]
            if n == 2:
                ways.append((c, 2.0))
        else:
            ways = [(x * m, 0.5 + 0.2 * (n - m)) for x in LOOKS.get(c, "") for m in ((1,) if n == 1 else (1, 2))]
            if c in SEPARATORS or inside and c in "*+!|":
                ways.append(("", JOIN))
            if spaced and inside and c in SEPARATORS:
                ways.append((" ", PART))
            if not ways:
                ways = [(c * n, 4.0)]
        yield ways


def decode(token: str, model: CharModel, longest: int = 64) -> str:
    """The most likely reading of a lower-case token. Viterbi over states of two characters; what all states agree on is put away."""
    settled = []
    states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    for k, ways in enumerate(readings(token), 1):
        following: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in states.items():
            for put, price in ways:
                now, at = cost + price, state
                for c in put:
                    now += model.cost(at, "$" if c == " " else c)
                    at = "^^" if c == " " else at[1] + c
                if at not in following or now < following[at][0]:
                    following[at] = (now, text + put)
        states = following
        if k % longest == 0:
            if max(len(text) for _, text in states.values()) > 16 * longest:  # never agreed: the best goes on
                states = dict([min(states.items(), key=lambda x: x[1])])
            same = commonprefix([text for _, text in states.values()])
            settled.append(same)
            states = {state: (cost, text[len(same) :]) for state, (cost, text) in states.items()}
    settled.append(min(((cost + model.cost(state, "$"), text) for state, (cost, text) in states.items()))[1])
    return "".join(settled)


class Kept(dict):
    """Results of a function of short keys, worked out once; emptied when full."""

    def __init__(self, of, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        found = self.of(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= 64:
            self[key] = found
        return found


def token_words(token: str, read) -> set[str]:
    """The words of a lower-case token, with the reading of a disguised one."""
    words = set()
    inner = token.lstrip(BEFORE).rstrip(AFTER)
    bare = inner.strip(EDGE)
    if bare.isalpha():
        words.add(bare)
        if len(bare) > 1 and (inner != bare or HIDDEN.search(bare)):  # a sign at an end may be a letter
            words.update(WORD.findall(read(inner)))
        return words
    words.update(WORD.findall(token))
    if HIDDEN.search(token):
        words.update(WORD.findall(read(inner)))
    return words


def restored(text: str, of_token: Kept, read) -> set[str]:
    """What ``of_token`` (a function of ``token_words``) gives for the tokens of a text, and the words of what is spaced out, which ``read`` reads."""
    low = text.lower()
    found = set().union(*map(of_token.__getitem__, set(low.split())))
    for m in SPACED.finditer(f" {low}"):
        found.update(WORD.findall(read(" ".join(m[1].split()))))
    return found


def features(word: str) -> set[str]:
    """The word and its pieces of 4 to 6 characters, with its ends marked."""
    text = f"^{word}$"
    return {f"={word}"} | {text[k : k + n] for n in (4, 5, 6) for k in range(len(text) - n + 1)}


class Model:
    """Feature weights, the character model and the logistic layer."""

    def __init__(self, weights: dict[str, float], chars: CharModel, layer: np.ndarray):
        self.weights, self.chars, self.layer = weights, chars, layer
        self.reads = Kept(lambda token: decode(token, self.chars), 100_000)
        self.read = self.reads.__getitem__
        self.starts = {f[:4] for f in weights if f[0] != "="}
        self.words = Kept(self.weight, 50_000)
        self.tokens = Kept(lambda token: tuple(token_words(token, self.read)), 100_000)
        #: Most tokens have no word of weight.
        self.telling = Kept(self.tells, 200_000)

    def tells(self, token: str) -> tuple[str, ...]:
        """Those of ``token_words`` that have weight; a token of letters that is not disguised is its only word."""
        inner = token if token.isalpha() else token.lstrip(BEFORE).rstrip(AFTER)
        if inner.isalpha() and not TRIPLE.search(inner):
            return (inner,) if self.weight(inner) > 0 else ()
        return tuple(w for w in token_words(token, self.read) if self.words[w] > 0)

    def weight(self, word: str) -> float:
        """The strongest of ``features(word)``; most words are passed over at their pieces of four characters."""
        text, get, starts = f"^{word}$", self.weights.get, self.starts
        best = get(f"={word}", 0.0)
        for k in [k for k in range(len(text) - 3) if text[k : k + 4] in starts]:
            best = max(best, get(text[k : k + 4], 0.0), get(text[k : k + 5], 0.0), get(text[k : k + 6], 0.0))
        return best

    def all_words(self, text: str) -> set[str]:
        return restored(text, self.tokens, self.read)

    def told(self, text: str) -> list[str]:
        """The words of a text that have weight."""
        return [w for w in restored(text, self.telling, self.read) if self.words[w] > 0]

    def inputs(self, told: list[str]) -> tuple[float, float, float]:
        return 1.0, math.log1p(math.fsum(map(self.words.__getitem__, told))), math.log1p(len(told))

    def score(self, text: str) -> float:
        z = float(np.dot(self.layer, self.inputs(self.told(text))))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def logistic(rows: DataFrame, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on ``a`` and ``b``, of ``n`` texts each; a step's sums are all that reaches the driver."""
    x = [F.lit(1.0), F.col("a"), F.col("b")]
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    w = np.zeros(3)
    for _ in range(steps):
        z = reduce(lambda s, t: s + t, (F.lit(float(v)) * c for v, c in zip(w, x)))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
        told = rows.select("*", p.alias("p"))
        curved = [F.sum(F.col("n") * x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i, j in upper]
        sums = told.agg(*curved, *[F.sum(F.col("n") * c * (F.col("toxic") - F.col("p"))) for c in x]).first()
        h = ridge * np.eye(3)
        for (i, j), v in zip(upper, sums):
            h[i, j] += v
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, np.array(sums[6:]) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-11:
            break
    return np.round(w, 9)  # sums of parts differ in their last digits


def plain_words() -> Callable[[str], set[str]]:
    """The words of a text, as they stand."""
    kept = Kept(lambda token: tuple(token_words(token, lambda _: "")), 100_000)
    return lambda text: set().union(*map(kept.__getitem__, set(text.lower().split())))


def all_features(chars: CharModel) -> AllFeatures:
    """All features of a text's restored words."""
    return AllFeatures(Model({}, chars, np.zeros(3)).all_words)


class AllFeatures:
    """All features of the words of a text; ``tallied`` counts them packed."""

    def __init__(self, words: Callable[[str], set[str]]):
        self.words = words

    def __call__(self, text: str) -> set[str]:
        return set().union(*map(features, self.words(text)))


class Tally:
    """How many texts of either label have a feature. ``of`` gives a text's features."""

    def __init__(self, of: Callable[[str], set[str]]):
        self.of, self.sums = of, (Counter(), Counter())

    def add(self, label: int, text: str) -> None:
        self.sums[label].update(self.of(text))

    def full(self) -> bool:
        return len(self.sums[0]) + len(self.sums[1]) > MOST_HELD

    def taken(self) -> list[pa.RecordBatch]:
        """``feature``, ``n0`` and ``n1`` of all that was added since the last time."""
        (a, b), self.sums = self.sums, (Counter(), Counter())
        found = list(a | b)
        return [counts_of(found, [a[f] for f in found], [b[f] for f in found])] if found else []


class PieceTally:
    """A ``Tally`` of all features of the texts' words. A piece is counted as a number, ``CHAR_BITS`` for each character; a feature may be taken in several rows."""

    def __init__(self, words: Callable[[str], set[str]]):
        self.words, self.held, self.letters = words, [], 0
        #: The number of a code point, 0 if it has none yet; the code points by their numbers.
        self.numbers, self.points = np.zeros(0x110000, np.int16), np.zeros(1, np.uint32)
        self.packed, self.rows = [], []

    def add(self, label: int, text: str) -> None:
        if words := self.words(text):
            self.held.append((label, words))
            self.letters += sum(map(len, words))
            if self.letters > LETTERS_AT_ONCE:
                self.count()

    def full(self) -> bool:
        if self.size() > MOST_HELD:
            self.merge()
        return self.size() > MOST_HELD // 2

    def size(self) -> int:
        return sum(len(pieces) for pieces, *_ in self.packed) + sum(r.num_rows for r in self.rows)

    def count(self) -> None:
        """Counts the texts held: pieces stay packed, words become rows."""
        held, self.held, self.letters = self.held, [], 0
        if not held:
            return
        number: dict[str, int] = {}
        places = np.array([number.setdefault(w, len(number)) for _, words in held for w in words])
        points = np.frombuffer(f"^{'$^'.join(number)}$".encode("utf-32-le"), np.uint32)
        new = np.unique(points[self.numbers[points] == 0])
        if len(self.points) + len(new) > 1 << CHAR_BITS:
            plain = Tally(lambda words: set().union(*map(features, words)))
            for label, words in held:
                plain.add(label, words)
            self.rows += plain.taken()
            return
        self.numbers[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points = np.concatenate([self.points, new])
        labels, sizes = [label for label, _ in held], np.array([len(words) for _, words in held])
        of_place = np.repeat(labels, sizes)
        self.rows.append(counts_of([f"={w}" for w in number], *(np.bincount(places[of_place == k], minlength=len(number)) for k in (0, 1))))
        codes, longs = self.numbers[points].astype(np.int64), np.array([len(w) + 2 for w in number])
        starts, packed = np.cumsum(longs) - longs, codes.copy()
        for n in range(2, 7):
            packed[: 1 - n] |= codes[n - 1 :] << CHAR_BITS * (n - 1)
            if n >= 4:
                several = np.maximum(longs - n + 1, 0)  # pieces of a word
                pieces, at = np.unique(packed[spans(starts, several)], return_inverse=True)
                at = at[spans((np.cumsum(several) - several)[places], several[places])]
                ends = np.cumsum(np.add.reduceat(several[places], np.cumsum(sizes) - sizes))
                sums = np.zeros((2, len(pieces)), np.int64)
                for label, low, high in zip(labels, [0, *ends[:-1]], ends):
                    sums[label][at[low:high]] += 1  # once, however often a text has it
                self.packed.append((pieces, *sums))

    def merge(self) -> None:
        """The packed counts as one, each piece once."""
        if self.packed:
            pieces, *counts = map(np.concatenate, zip(*self.packed))
            order = np.argsort(pieces, kind="stable")
            pieces = pieces[order]
            starts = np.flatnonzero(np.diff(pieces, prepend=-1))
            self.packed = [(pieces[starts], *(np.add.reduceat(n[order], starts) if len(starts) else n for n in counts))]

    def taken(self) -> list[pa.RecordBatch]:
        self.count()
        self.merge()
        for pieces, n0, n1 in self.packed:
            letters = self.points[np.stack([(pieces >> CHAR_BITS * k & (1 << CHAR_BITS) - 1).astype(np.int16) for k in range(6)], axis=1)]
            self.rows.append(counts_of(np.ascontiguousarray(letters).view("U6").ravel(), n0, n1))
        rows, self.packed, self.rows = self.rows, [], []
        return rows


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each start the numbers from it on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def counts_of(found, n0, n1) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], ["feature", "n0", "n1"])


def tallied(rows: DataFrame, make_of: Callable[[], Callable]) -> DataFrame:
    """``feature`` and, as ``n0`` and ``n1``, the numbers of rows (toxic, text) of either label that have it, each task's for itself. ``make_of`` runs in each task and returns a function from a text to its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make_of()
        tally = PieceTally(of.words) if isinstance(of, AllFeatures) else Tally(of)
        for batch in batches:
            for part in in_slices(batch, AT_ONCE):
                for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        tally.add(label, text)
                if tally.full():
                    yield from tally.taken()
        yield from tally.taken()

    return rows.mapInArrow(run, "feature string, n0 bigint, n1 bigint")


def summed(counts: DataFrame) -> DataFrame:
    """What the tasks of ``tallied`` counted, one row for each feature."""
    return counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def counted(rows: DataFrame, make_of: Callable[[], Callable]) -> DataFrame:
    """``tallied`` over all rows of a fit."""
    return tallied(rows, make_of)


def fit(labelled: DataFrame, max_train: int | None = None, min_texts: int = 8, min_z: float = 6.0, max_features: int = 100_000) -> Model:
    """A model from ``doc_id``, ``text`` and ``toxic`` (0 or 1).

    All that reaches the driver is bounded: the most frequent words for the character model, the
    significant features, and the sums of each step of the logistic layer.
    """
    rows = labelled.where("toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    if max_train is not None:
        rows = rows.join(rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "doc_id")
    kept = written(rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("row")).select("doc_id", "row.toxic", "row.text"))
    size = dict(kept.groupBy("toxic").count().collect())
    if len(size) < 2:
        dropped(kept)
        return Model({}, CharModel({}), np.array([-35.0, 0.0, 0.0]))
    rows = kept.select("toxic", "text")
    # both classes weigh the same, so that the model knows what the rarer one says
    words = summed(counted(rows, plain_words)).withColumn("weight", F.col("n0") / size[0] + F.col("n1") / size[1])
    top = words.where(F.length("feature") <= 48).coalesce(TOP_PARTS).orderBy(F.desc("weight"), "feature").limit(50_000).select("feature", "weight").collect()
    chars = CharModel({r[0]: r[1] for r in top})
    n0, n1 = F.col("n0"), F.col("n1")
    gain = F.log((n1 + 0.5) / (size[1] + 1)) - F.log((n0 + 0.5) / (size[0] + 1))
    both = (n0 + n1) / (size[0] + size[1])
    z = (n1 / size[1] - n0 / size[0]) / F.sqrt(both * (1 - both + 1e-9) * (1 / size[0] + 1 / size[1]))  # of two shares

    def strong(counts: DataFrame) -> DataFrame:
        return counts.where(n1 >= min_texts).select("feature", gain.alias("gain"), z.alias("z")).where(F.col("z") >= min_z).where("gain >= 2.5")

    # two parts, in which each text is once: those of the first have no text in the second
    first = (F.col("toxic") == 1) | (F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_BY)) == 0)
    begun = tallied(kept.where(first).select("toxic", "text"), lambda: all_features(chars))
    rest = counted(kept.select("toxic", F.when(~first, F.col("text")).alias("text")), lambda: all_features(chars))
    chosen = strong(summed(begun.unionAll(rest))).orderBy(F.desc("z"), "feature").limit(max_features).collect()
    model = Model({r[0]: r[1] for r in chosen}, chars, np.zeros(3))
    made = evidence(rows, model).groupBy("toxic", "a", "b").agg(F.count(F.lit(1)).alias("n")).persist()
    model.layer = logistic(made)
    made.unpersist()
    dropped(kept)
    return model


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``toxic`` and the inputs of the logistic layer, for every row."""
    weights, grams, bases = model.weights, model.chars.grams, model.chars.bases

    def make():
        own = built(weights, grams, bases, np.zeros(3))

        def one(batch):
            found = [own.inputs(own.told(text)) for text in strings(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for _, a, _ in found], pa.float64()), pa.array([b for *_, b in found], pa.float64())], ["toxic", "a", "b"])

        return one

    return over_batches(rows, make, "toxic int, a double, b double", AT_ONCE)


def built(weights: dict[str, float], grams: list[dict], bases: list[dict], layer: np.ndarray) -> Model:
    """A model inside a task, its caches empty."""
    chars = CharModel({})
    chars.grams, chars.bases = grams, bases
    return Model(weights, chars, layer)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, from 0 to 1, for every row; one pass, no shuffle."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights, grams, bases, layer = model.weights, model.chars.grams, model.chars.bases, model.layer

    def make():
        own = built(weights, grams, bases, layer)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(own.score, strings(batch)), pa.float64())], ["doc_id", "score"])

    return over_batches(chosen, make, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double", AT_ONCE)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns as they were."""
    at = docs.columns.index("text")
    names = [f"c{k}" for k in range(len(docs.columns))]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    weights, grams, bases, layer = model.weights, model.chars.grams, model.chars.bases, model.layer

    def make():
        own = built(weights, grams, bases, layer)
        return lambda batch: batch.filter(pa.array([own.score(x or "") < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return over_batches(docs.toDF(*names), make, fields, AT_ONCE).toDF(*docs.columns)
