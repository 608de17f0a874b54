"""Each stage of the pipeline, and all of them, against rules worked out in plain Python.

The fixture holds toxic texts, exact and near copies, benchmark passages, personal data, missing and empty
texts, repeated rows, a row without an id and a very long text.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.common import crc_part
from millrace.llm.queries import QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a in ("bar", "lim", "ton", "ver", "sal") for b in ("ka", "do", "mi", "ru") for c in ("n", "st", "l", "rd", "p")]
ITEMS = [" ".join(random.Random(f"item{k}").choices(VOCABULARY, k=12 + k)) for k in range(5)]


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choices(VOCABULARY, k=n))


def documents() -> list[tuple]:
    draw = random.Random(3)
    texts: list[tuple[int | None, str | None]] = []
    for k in range(240):
        texts.append((k, sentence(draw, 40) + (" you idiot" if k % 4 == 0 else "")))
    clean = [k for k in range(240) if k % 4]
    for n, k in enumerate(clean[:12]):  # copies and near copies, in chains: one word more at the end, then one at the start
        texts += [(300 + n, texts[k][1]), (320 + n, texts[k][1].upper() + " more"), (340 + n, "again " + texts[k][1] + " more")]
    for n, k in enumerate(clean[20:24]):  # half of a text is not a near copy
        texts.append((360 + n, texts[k][1][:120] + " " + sentence(draw, 25)))
    for n, item in enumerate(ITEMS):
        edited = item.split()
        edited[5] = "changed"
        texts += [(400 + n, f"{sentence(draw, 20)} {item}! {sentence(draw, 9)}"), (410 + n, f"{sentence(draw, 20)} {' '.join(edited)} {sentence(draw, 9)}")]
        texts.append((420 + n, f"{sentence(draw, 20)} {' '.join(item.split()[:6])} {sentence(draw, 30)}"))
    texts += [(500 + n, f"{sentence(draw, 15)} write to a{n}.b@mail{n}.example.org from 10.0.0.{n}") for n in range(5)]
    texts += [(600, None), (601, None), (602, ""), (603, ""), (604, " \n"), (605, "one"), (None, sentence(draw, 30)), (606, sentence(draw, 6000))]
    texts += [(1, texts[1][1]), (1, texts[1][1]), (500, texts[-9][1] if texts[-9][0] == 500 else "repeated id, other text"), (600, None)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 4 == 0), 0.5) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality double").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (5, None), (6, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def bag(rows) -> list[str]:
    return sorted(str(tuple(r)) for r in rows)


def clean_of_toxic(rows):
    return [r for r in rows if "idiot" not in (r[1] or "")]


def shingles(text: str | None) -> set:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def least_of_each_group(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    least = {i: i for i, _ in sets}

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return [r for r in rows if r[0] is None or root(r[0]) == r[0]]


def best(item: list[str], text: list[str]) -> int:
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i]
        for j, v in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (w != v)))
    return min(row)


def without_benchmark(rows):
    items = [x.split() for x in ITEMS]
    return [r for r in rows if not any(best(x, (r[1] or "").replace("!", " ").lower().split()) <= len(x) // 5 for x in items)]


def hidden(rows):
    out = []
    for i, t, lang, source, n in rows:
        if t and "@" in t:
            k = next(k for k in range(5) if f"10.0.0.{k}" in t)
            t = t.replace(f"a{k}.b@mail{k}.example.org", "<EMAIL>").replace(f"10.0.0.{k}", "<IP>")
        out.append((i, t, lang, source, n if t is None else len(t)))
    return out


EXPECTED = [clean_of_toxic, least_of_each_group, without_benchmark, hidden]


@pytest.mark.parametrize("at", range(4), ids=[name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stage(spark, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = table(spark, documents())
    got = stage(spark, docs, folder)
    assert got.schema == docs.schema
    assert bag(got.collect()) == bag(EXPECTED[at](documents()))
    assert stage(spark, docs.limit(0), folder).collect() == []


def packed(rows) -> list[tuple]:
    """Pieces (doc_id, piece, start, length, checksum) of all rows."""
    encoder = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    out = []
    for i, t, *_ in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, n, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    return out


def test_whole_run(spark, folder):
    rows = documents()
    for step in EXPECTED:
        rows = step(rows)
    out = corpus_pipeline.run(spark, folder).collect()
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == bag(packed(rows))
    sequences: dict[int, list] = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_labels_of_the_held_out_part_are_never_learned_from(spark, folder):
    """Scores stay as they are when all held-out labels are turned round."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = crc_part(labels["doc_id"], 3) == 1
    turned = f"{folder}/turned"
    labels.selectExpr("doc_id", "toxic", "quality").withColumn("toxic", held.cast("int") * (1 - labels["toxic"]) + (~held).cast("int") * labels["toxic"]).write.parquet(f"{turned}/labels.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{turned}/documents.parquet")
    assert bag(QUERIES["op8_toxicity"](spark, folder).collect()) == bag(QUERIES["op8_toxicity"](spark, turned).collect())
