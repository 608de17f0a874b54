"""Decontamination against all distances, worked out whole on a small fixture."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam


def least_distances(item: list[str], text: list[str]) -> int:
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i]
        for j, v in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (w != v)))
    return min(row)


def words(text: str | None) -> list[str]:
    """As the contract has them: A-Z lower-cased, ASCII punctuation and white space cut."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").translate(str.maketrans(decontam.PUNCTUATION.decode(), " " * 32)).split()


def tables(spark):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(1, 31)))) for k in range(40)]
    items += [(40, None), (41, ""), (42, "?!"), (None, "lone item under no id"), (43, items[7][1].upper() + "!"), (7, items[7][1]), (44, "Ünïcode Wörter, élan; vital")]
    texts = []
    for k in range(60):
        held = words(items[k % 40][1])
        for _ in range(random.randint(0, len(held) // 4)):
            held[random.randrange(len(held))] = random.choice(vocabulary)
        texts.append((k, " ".join(random.choices(vocabulary, k=25)) + "\n" + ", ".join(held) + " " + " ".join(random.choices(vocabulary, k=9))))
    texts += [(60, None), (61, ""), (62, " \n"), (63, "A lone item, under no ID!"), (3, texts[3][1]), (None, texts[5][1]), (None, "clean"), (64, "ünïcode wörter élan vital"), (66, "ÜnïCODE WÖrter élan vital"), (65, "pad " * 900 + items[20][1])]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, item_id string, words int")
    return texts, items, docs, spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block, starts, candidates", [(8 << 20, 1 << 17, 1 << 20), (60, 7, 5)])
def test_every_pair_and_distance(spark, monkeypatch, block, starts, candidates):
    """Whatever the size of blocks and runs; items under SHORT words miss nothing."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "RUN_STARTS", starts)
    monkeypatch.setattr(decontam, "RUN_CANDIDATES", candidates)
    texts, items, docs, benchmark = tables(spark)
    want = []
    for i, text in texts:
        for k, item in items:
            own = words(item)
            if own and (d := least_distances(own, words(text))) <= int(0.2 * len(own)):
                want.append((i, k, d, len(own)))
    got = decontam.find(docs, benchmark).collect()
    key = lambda r: [(-1 if x is None else x) for x in r]
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    by_id, item_of = dict(texts[:60] + texts[60:64] + texts[67:]), dict(reversed(items))
    for r in got:
        if r["doc_id"] is not None:
            part = words(by_id[r["doc_id"]])[r["start_word"] : r["end_word"]]
            assert least_distances(words(item_of[r["item_id"]]), part) == r["distance"]


def test_rows_stay_or_go_by_their_own_text(spark):
    texts, _, docs, benchmark = tables(spark)
    hit = {(r["doc_id"]) for r in decontam.find(docs, benchmark).where("doc_id IS NOT NULL").collect()}
    kept = decontam.keep_clean(docs, benchmark)
    assert kept.schema == docs.schema
    want = [t for t in texts if (t[0] not in hit if t[0] is not None else t[1] == "clean")]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert decontam.keep_clean(docs.limit(0), benchmark).collect() == []
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(texts)


def test_equal_items_are_looked_for_once(spark):
    """10,000 copies of a word that a long text repeats 50,000 times."""
    benchmark = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit("Again!").alias("text"))
    docs = spark.createDataFrame([(1, "again " * 50_000), (2, "never")], "doc_id long, text string")
    blocks = decontam.Blocks(benchmark.select(decontam.normal(F.col("text")).alias("words")), 0.2)
    assert decontam.find_classes(docs, blocks).count() == 1
    assert decontam.find(docs, benchmark).agg(F.count("*"), F.min("item_id"), F.max("item_id"), F.max("doc_id")).first()[:] == (10_000, 0, 9_999, 1)
    assert [r["doc_id"] for r in decontam.keep_clean(docs, benchmark).collect()] == [2]
