"""Places where a text operator once did less than the whole job."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ctw, decontam, toxicity, urls


def test_repeated_rows_score_their_rare_words_once(spark, monkeypatch):
    """Each row against brute force when nearly all words are outside the frequent ones."""
    monkeypatch.setattr(ctw, "FREQUENT", 2)
    texts = [(1, "a a b c d"), (1, "a a b c d"), (2, "c e e f"), (2, "zz c"), (3, None), (4, "A b g" + "x" * 80)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    counts = Counter(w for i, t in texts if i < 3 for w in (t or "").lower().split())
    base = sum(counts.values()) + 4 + 0.5 * (len(counts) + 2)
    want = []
    for i, t in texts:
        words = (t or "").lower().split()
        score = sum(math.log10((counts[w] + 0.5) / base) for w in words) + math.log10(4.5 / base)
        want.append((i, len(words) + 1, sum(w in counts for w in words) + 1, pytest.approx(score)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in ctw.score(rows, rows["doc_id"] < 3).collect()]
    assert sorted(got) == sorted(want, key=lambda x: (*x[:3], x[3].expected))


@pytest.mark.parametrize("hot", [20, 1_000_000])
def test_every_context_takes_part_whatever_is_joined(spark, monkeypatch, hot):
    """Scores against the tree in memory with all contexts, where rare contexts are far below 2^-12 of the bytes."""
    monkeypatch.setattr(ctw, "HOT", hot)
    texts = [(0, "the same line again " * 600), (1, "Zebra quilts vex"), (2, "zebra quilts vex"), (2, "zebra quilts vex"), (3, "never trained é"), (4, None), (5, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    counts: list[dict] = [{} for _ in range(5)]
    for x in ctw.codes([(t or "").lower().encode() for i, t in texts if i in (0, 1, 5)]).tolist():
        for d in range(5):
            counts[d].setdefault((x >> 8) & ((1 << 8 * d) - 1), np.zeros(256))[x & 255] += 1
    tree = ctw.Tree(counts)
    got = ctw.score(rows, rows["doc_id"].isin(0, 1, 5)).select("doc_id", "score").collect()
    want = zip((i for i, _ in texts), tree.scores([(t or "").lower().encode() for _, t in texts]))
    assert sorted(map(tuple, got)) == [(i, pytest.approx(x, rel=1e-5)) for i, x in sorted(want)]


def test_items_of_every_length_are_found_at_the_most_edits():
    """Substitutions, deletions and insertions, as many as the ratio allows; no item under SHORT words is missed."""
    random.seed(8)
    for n in range(5, 61):
        items = [(k, " ".join(f"w{random.randrange(10**6)}" for _ in range(n)).encode()) for k in range(30)]
        texts = []
        for _, item in items:
            words = item.decode().split()
            for _ in range(int(0.2 * n)):
                at, kind = random.randrange(len(words)), random.randrange(3)
                words[at : at + (kind < 2)] = [f"x{random.randrange(10**6)}"] if kind else []
            texts.append(f"before it {' '.join(words)} and after it".encode())
        found = {(t, k) for t, k, *_ in decontam.held(texts, decontam.Index(items), 0.2)}
        assert sum((k, k) in found for k in range(30)) >= (30 if n < decontam.SHORT else 29), n


def toxic_model() -> toxicity.Model:
    chars = toxicity.CharModel(dict.fromkeys("we went over the hill and read good books in a fine garden you are an idiot".split(), 1.0))
    return toxicity.Model({"=idiot": 5.0, "idiot": 5.0}, chars, np.array([-4.0, 6.0, 0.0]))


def test_toxic_word_late_in_a_spaced_or_glued_passage():
    model = toxic_model()
    plain = "wewentoverthehillandreadgoodbooksinafinegardenwewentoverthehill"
    assert len(plain) > 60
    for text in (" ".join(plain + "youareanidiot" + plain), plain + "idiot", plain + "idiot" + plain * 5):
        assert model.score(text) > 0.9 and model.score(text.replace("idiot", "garden").replace("i d i o t", "g a r d e n")) < 0.1
    assert "idiot$" in toxicity.features(plain + "idiot")


def test_spaced_passage_keeps_its_words():
    model = toxic_model()
    assert "idiot" in model.all_words(" ".join("wewentoverthehillandyouareanidiotinafinegarden"))


def test_repeated_address_does_not_fill_the_sample(spark):
    """One address with more rows than the bound, wherever it hashes; both classes are learned from and counts weigh."""
    for name in ("a", "b", "c", "d"):
        hot = [("hot.org", f"/{name}", 0)] * 300
        rows = hot + [("good.org", f"/fine/{k}", 0) for k in range(40)] + [("bad.org", f"/evil/{k}", 1) for k in range(40)]
        table = spark.createDataFrame(rows, "host string, path string, label int").coalesce(2)
        model = urls.fit(table, max_labelled=60)
        assert not isinstance(model, float)
        tests = spark.createDataFrame([("good.org", "/fine/99"), ("bad.org", "/evil/99")], "host string, path string").coalesce(1)
        got = {r["host"]: r["prediction"] for r in model.transform(urls.hashed(tests)).collect()}
        assert got == {"good.org": 0.0, "bad.org": 1.0}
