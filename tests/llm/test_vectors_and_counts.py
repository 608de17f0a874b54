"""Vector codes, hard negatives and token counts against plain Python on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import codes, counts, negatives
from millrace.llm.queries import COUNTED_BY, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string, number int"


def vectors(n: int, width: int, seed: int = 1):
    """Rows with few distinct values, so that many distances and scores are equal, and clashing extra columns."""
    random.seed(seed)
    rows = [(i, [random.randrange(-3, 4) / 8 for _ in range(width)], random.choice([0, 0, 0, 1, 2, None]), 7, "x", 9) for i in range(n)]
    broken = [[None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), None, []]
    return rows + [(n + k, v, 1, 7, "x", 9) for k, v in enumerate(broken)] + [rows[3], rows[3], (rows[5][0], rows[6][1], 2, 7, "x", 9)]


def kept(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def lloyd(rows, scale, parts, entries, rounds):
    """Plain Lloyd: every part looks at every entry in every round."""
    cut = [[[math.floor(scale * x) for x in r[1]][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts] for p in range(parts)] for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    for done in range(rounds + 1):
        got = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        if done < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [v[p] for v, g in zip(cut, got) if g[p][1] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    return [([k for _, k in g], sum(d for d, _ in g)) for g in got], books


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_codes_equal_plain_lloyd(spark, block):
    rows = vectors(60, 8)
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), 16, 4, 5, 6, block)
    want, entries = lloyd(kept(rows), 16, 4, 5, 6)
    assert books.entries.tolist() == entries
    assert sorted((r["vec_id"], r["label"] or -1, list(r["code"]), r["error"]) for r in got.collect()) == sorted((r[0], r[2] or -1, c, e) for r, (c, e) in zip(kept(rows), want))


def test_unmoved_entries_keep_their_parts_also_in_ties():
    random.seed(5)
    for _ in range(200):
        part = np.array([[random.randrange(4), random.randrange(4)] for _ in range(30)])
        book = np.array([[random.randrange(4), random.randrange(4)] for _ in range(6)])
        code, distance = codes.nearest(part, book)
        after = book + np.array([[random.choice([0, 0, 1]), 0] for _ in book])
        moved = (after != book).any(1)
        for a, b in zip(codes.renewed(part, after, moved, code, distance), codes.nearest(part, after)):
            assert a.tolist() == b.tolist()


def test_label_errors_join_missing_labels(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 5), (1, 6), (None, 2), (None, 3)], "label int, error long")
    for few in (0, 100):
        monkeypatch.setattr(codes, "FEW_LABELS", few)
        assert sorted((r["label"] or 0, r["label_error"]) for r in codes.with_label_error(rows).collect()) == [(0, 5), (0, 5), (1, 11), (1, 11)]


def test_codes_of_few_and_no_rows(spark):
    rows = vectors(9, 8)[:2]
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA), 16, 4, 5)
    assert [r["error"] for r in got.collect()] == [0, 0] and books.entries.shape == (4, 2, 2)
    got, books = codes.compress(spark.createDataFrame([(1, None, 1, 7, "x", 9)], SCHEMA))
    assert codes.with_label_error(got).collect() == [] and books.entries.size == 0


def test_uneven_and_huge_vectors_are_refused(spark):
    for bad in ([0.0] * 9, [0.0] * 16, [1e30] * 8):
        rows = [(1, [0.0] * 8, 1, 7, "x", 9), (2, bad, 1, 7, "x", 9)]
        with pytest.raises(Exception, match="several lengths|beyond"):
            codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(1))[0].collect()


def mined(rows, anchors, scale, positives, negatives_):
    """Every anchor against every row."""
    rows = [(i, [math.floor(scale * x) for x in v], l) for i, v, l, *_ in kept(rows) if l is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, l in [x for k, x in enumerate(rows) if anchors(x[0]) and x not in rows[:k]]:
        best = lambda found: sorted({(-dot(v, w), j) for j, w in found})
        for p, j in best([(j, w) for j, w, m in rows if m == l and j != i])[:positives]:
            found = [(s, k) for s, k in best([(k, w) for k, w, m in rows if m != l]) if 80 * -p <= 100 * -s <= 100 * -p]
            out += [(i, j, n, k, -p, -s) for n, (s, k) in enumerate(found[:negatives_], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors", "chunk", "tile", "sparse"), [(4096, 512, 1 << 18, 8192, 0.05), (5, 3, 11, 4, 1.1), (16, 2, 16, 3, 0.0)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, block, anchors, chunk, tile, sparse):
    for name, value in {"BLOCK": block, "ANCHORS": anchors, "CHUNK": chunk, "TILE": tile, "SPARSE": sparse, "LEVELS": (2, 3)}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(90, 8, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = negatives.hard_negatives(df, df["vec_id"] % 5 == 0, 16, 3, 4)
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())
    assert got == mined(rows, lambda i: i % 5 == 0, 16, 3, 4) and len(got) > 50


def test_bounds_hold_every_score():
    random.seed(4)
    a, b = (np.array([[random.randrange(-500, 500) for _ in range(13)] for _ in range(50)]) for _ in range(2))
    for pieces in (1, 3, 5, 13, 20):
        (m, s), (n, t) = negatives.summaries(a, pieces), negatives.summaries(b, pieces)
        exact, slack = a @ b.T, 1e-3
        assert (exact <= m @ n.T + s @ t.T + slack).all() and (exact >= m @ n.T - s @ t.T - slack).all()


def test_no_anchors_no_positives_no_rows(spark):
    one = [(0, [1.0] * 8, 1, 7, "x", 9), (1, [1.0] * 8, 2, 7, "x", 9)]
    df = spark.createDataFrame(one, SCHEMA)
    assert negatives.hard_negatives(df, df["vec_id"] == 9).collect() == []
    assert negatives.hard_negatives(df, df["vec_id"] == 0).collect() == []
    assert negatives.hard_negatives(df.limit(0), df["vec_id"] == 0).collect() == []


def test_large_components_score_exactly(spark):
    big = float((1 << 26) - 3)
    rows = [(i, [big - i, 1.0 + i, big + 2 * i], i % 2, 7, "x", 9) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = negatives.hard_negatives(df, df["vec_id"] < 3, 1)
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())
    assert got == mined(rows, lambda i: i < 3, 1, 5, 5) and got


TEXTS = [None, "", " ", "\n\n  \t x", "it's we'll I'm they'd", "naïve café 中文字 ไทย 🙂🙂 a‍b", "0123456789 12,5 % <b>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "x" * 50_000, "\x1c\x1f\x85\xa0　  x", "ab" * 3000 + " " * 5000, "word " * 30_000]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(COUNTED_BY))
    rows = [(k, t, "mine", 5) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again", 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_bytes string, n_tokens int")
    got = counts.count_tokens(df, public_tokenizers.path(COUNTED_BY))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect())) == sorted((*w, w[2] > 1024) for w in want)
    assert counts.count_tokens(df.limit(0), public_tokenizers.path(COUNTED_BY)).collect() == []


def test_counts_of_random_texts_and_a_full_table():
    path = public_tokenizers.path(COUNTED_BY)
    library, count = Tokenizer.from_file(path), counts.Counter(path, limit=20)
    random.seed(9)
    for _ in range(3000):
        text = "".join(random.choice("aeinrst THE'sdm.,! \n\t 0123é中́​\U0001d400") for _ in range(random.randrange(80)))
        assert count.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert len(count) <= 20 and len(count.older) <= 20


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_registered_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path(COUNTED_BY))
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op13_token_counts"](spark, FOLDER).collect()}
    assert got == {d["doc_id"]: len(library.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}
