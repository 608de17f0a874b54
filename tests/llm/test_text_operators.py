"""The text operators against brute force, on small tables with nulls, empty texts, ties and extra columns."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from millrace.llm import binary, ctw, decontam, licenses, minhash, packing, pii, quality, tokens, toxicity, urls
from millrace.llm.common import over_batches, perhaps_among

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox jumps over the lazy dog and runs on " * 400
TEXTS = [None, "", " \n", "one", "Two words", "Two words", "Write to a.b+c@mail.example.org or +49 (30) 123-4567, 10.0.0.255 and 4111 1111 1111 1111.", LONG, "é ü ß <|endoftext|> x\x1fy 's don't"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "a", 1, "mine") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


def encoded(text: str | None) -> list[int]:
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (licenses.scan(none), pii.find(none), packing.pack_documents(none, PATH), minhash.classes(none), quality.rules(none), decontam.find(none, none.selectExpr("doc_id AS item_id", "text")), ctw.score(none, none["doc_id"] > 0), binary.round_trip(none, PATH), pii.redact(none)):
        assert out.count() == 0


def test_packing(docs):
    got = packing.pack_documents(docs, PATH, capacity=64).toPandas()
    for i, text in enumerate(TEXTS):
        ids = encoded(text) + [0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 64))
        assert own.ids_crc32.tolist() == [crc(ids[a : a + 64]) for a in own.start]
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= 64


def test_placement_equals_sums_of_squares_worked_out_whole():
    """Each piece where the sum of squared counts of open gaps becomes smallest, the smallest gap winning ties."""
    random.seed(6)
    for _ in range(300):
        capacity = random.choice([12, 20, 31])
        lengths = sorted((random.randrange(1, capacity + 1) for _ in range(60)), reverse=True)
        gaps, want = [], []
        for size in lengths:
            open_gaps = sorted({g for g in gaps if g >= size})

            def after(gap):
                left = [g for g in gaps if g]
                left.remove(gap)
                left += [gap - size] * (gap > size)
                return sum(left.count(g) ** 2 for g in set(left)), gap

            if open_gaps:
                _, gap = min(map(after, open_gaps))
                gaps[gaps.index(gap)] -= size
            else:
                gap = capacity
                gaps.append(capacity - size)
            want.append(capacity - gap)
        _, offset = packing.sum_of_squares(np.array(lengths), capacity)
        assert offset.tolist() == want, lengths


def test_tables_of_two_generations_keep_their_results():
    encode = tokens.Encoder(PATH)
    encode.pieces.limit = 7
    text = " ".join(f"word{k % 23} other{k % 5}, it's {k}" for k in range(300))
    assert np.frombuffer(encode(text), encode.dtype).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    texts = [text, "", "é ß İ x\x1cy <|endoftext|> ok", "x" * 200, text[::-1]]
    assert list(encode.many(texts, 50)) == [encode(t) for t in texts] == list(encode.many(texts))
    assert len(encode.pieces) <= 7 and len(encode.pieces.older) <= 7


def test_sum_of_squares_is_tight():
    draw = np.random.default_rng(1)
    lengths = np.sort(draw.integers(1, 2049, 3000))[::-1]
    sequence, _ = packing.sum_of_squares(lengths, 2048)
    assert sequence.max() + 1 <= math.ceil(lengths.sum() / 2048) * 1.02


def test_token_files(docs):
    got = binary.round_trip(docs, PATH).toPandas().sort_values("doc_id")
    ids = [encoded(t) + [1] for t in TEXTS]
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    assert got.ids_crc32.tolist() == [crc(x) for x in ids]


def brute_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in tests.items()}


def test_base_spans_equal_the_patterns():
    random.seed(2)
    parts = ["a", "b1", "@", ".", "x.org", "+", "4111111111111111", "10.0.0.1", "256", " ", "-", "(", ")", "49", "301234567", "é", "0", "https://x.de/a", "token = ", "%"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        found = pii.spans_of(text)
        for k, kind in enumerate(pii.KINDS[:4]):
            assert [(a, b) for n, a, b in found if n == k] == brute_spans(text)[kind], text


def test_redaction(docs):
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[6]["text"].startswith("Write to <EMAIL> or <PHONE>") and out[6]["n_chars"] == len(out[6]["text"])
    assert out[0]["text"] is None and out[3]["text"] == "one" and out[3]["spans"] == "mine"


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality.rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in range(k, k + 5)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert got[i]["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_near_duplicates(spark):
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = random.choices(vocabulary, k=random.choice([1, 3, 30, 120]))
        for edits in (0, 0, 1, 3, 9, 20):
            copy = list(base)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(4):  # sets larger than what a block carries
        base = random.choices(vocabulary, k=900)
        for edits in [0, *random.choices(range(15, 50), k=14)]:
            copy = list(base)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    random.shuffle(texts)
    texts += [None, "", "A b", "a B"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(rows, size=2).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(sets))] == label


def test_decontamination_recall():
    random.seed(5)
    vocabulary, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    items = [(i, " ".join(random.choices(vocabulary, weights, k=random.randint(9, 57))).encode()) for i in range(120)]
    index = decontam.Index(items)
    for rate, least in ((0, 1.0), (0.1, 0.95), (0.2, 0.85)):
        texts = []
        for _, item in items:
            words = item.decode().split()
            for _ in range(int(rate * len(words))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            texts.append(" ".join(random.choices(vocabulary, weights, k=100) + words + random.choices(vocabulary, weights, k=50)).encode())
        found = {(t, k) for t, k, *_ in decontam.held(texts, index, 0.2)}
        assert sum((k, k) in found for k in range(len(items))) >= least * len(items)
        assert all(t == k for t, k in found)


def test_tree_probabilities(monkeypatch):
    """What the tree predicts is the quotient of weighted block probabilities with and without the byte."""
    monkeypatch.setattr(ctw, "DEPTH", 2)
    counts: list[dict] = [{}, {}, {}]
    for x in ctw.codes([b"abracadabra", b"aa", b""]).tolist():
        for d in range(3):
            counts[d].setdefault((x >> 8) & ((1 << 8 * d) - 1), np.zeros(256))[x & 255] += 1

    def whole(counts, d=0, c=0):
        own = ctw.kt_log(*ctw.decisions(counts[d][c][None]))[0]
        if d == 2:
            return own
        return np.logaddexp(own, sum(whole(counts, d + 1, k) for k in counts[d + 1] if k & ((1 << 8 * d) - 1) == c)) + np.log(0.5)

    tree = ctw.Tree(counts)
    assert np.allclose((10 ** tree.log_p.astype(float)).sum(1), 1, atol=1e-5)
    for byte in b"rz":
        more = [{k: v.copy() for k, v in c.items()} for c in counts]
        for d in range(3):
            more[d][(ord("a") << 8 | ord("b")) & ((1 << 8 * d) - 1)][byte] += 1
        at = tree.places(np.frombuffer(b"ab" + bytes([byte]), np.uint8), np.array([2]))
        assert tree.log_p[at[0], byte] == pytest.approx((whole(more) - whole(counts)).sum() / math.log(10), abs=1e-5)


def test_licence_rules(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. Other words.\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    swapped = "\n".join(reversed(text.split("\n")))
    rows = spark.createDataFrame([(1, text), (2, swapped), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan(rows).collect()} == {1: ("6,7", "MIT"), 2: ("7,6", ""), 3: ("", "")}


def test_url_rules(spark):
    rules = (("allow", "org/"), ("block", "example.org/es/"))
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://x.org/es/"), (3, "https://x.org"), (4, None), (5, "no scheme"), (6, "a://b?c/d")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("a.example.org", "/es/1", "example.org/es/"), 2: ("x.org", "/es/", "org/"), 3: ("x.org", "", None), 4: ("", "", None), 5: ("", "", None), 6: ("b", "", None)}


def labelled_texts(spark):
    random.seed(6)
    plain = ["this is fine and good text", "we went over the hill", "reading books in the garden", "that was a nice day for them", "the class will pass over there", "sit here with us"]
    bad = ["idiot", "shit", "ass"]
    rows = [(i, " ".join(random.sample(plain, 2)) + (f" you {bad[i // 4 % 3]}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    return rows, "doc_id long, text string, toxic int"


def test_disguises(spark):
    rows, schema = labelled_texts(spark)
    model = toxicity.fit(spark.createDataFrame(rows, schema))
    hidden = ["you $hit", "you !diot", "you i  d  i  o  t", "you\ni\nd\ni\no\nt\n", "you a s s", "you (1d10t)", "as$", "t h e a s s h e r e", "you s.h.i.t", "you i-d-i-o-t!", "1d10t", "sh!t", "a $ $"]
    clean = ["a b c", "we went (over) the hill!", "it is as he was", "$100 for 1 2 3 books", "the class will pass", "w e w e n t o v e r", "+the $garden !books"]
    found = {t: model.score(t) >= toxicity.THRESHOLD for t in hidden + clean}
    assert found == {**dict.fromkeys(hidden, True), **dict.fromkeys(clean, False)}


def test_an_id_counts_once_in_the_sample(spark):
    rows, schema = labelled_texts(spark)
    once = spark.createDataFrame(rows, schema)
    often = spark.createDataFrame(rows + [rows[0]] * 3000 + [(rows[1][0], "zzz", 1)], schema)
    a, b = toxicity.fit(once, max_train=200), toxicity.fit(often, max_train=200)
    assert a.weights == b.weights and a.weights and np.allclose(a.layer, b.layer)


def test_toxicity(spark):
    random.seed(6)
    plain = ["this is fine and good text", "we went over the hill", "reading books in the garden", "that was a nice day for them"]
    rows = [(i, " ".join(random.sample(plain, 2)) + (" you idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    tests = ["this is fine", "you idiot", "you 1d10t", "you i d i o t", "you idiooooot", "", None]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    assert [got[i] >= toxicity.THRESHOLD for i in range(len(tests))] == [False, True, True, True, True, False, False]
    nothing = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").limit(0))
    assert nothing.score("you idiot") < 0.5


def test_toxicity_learns_from_all_labels(spark):
    """More labelled ids than an earlier bound of 20,000 all count; words of any small part of them are learned."""
    bad = [f"{a}{b}{c}mur" for a in "bdfg" for b in "aeio" for c in "klmn"]
    rows = spark.range(24_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("you "), F.get(F.array(*[F.lit(w) for w in bad]), (F.col("id") / 8).cast("int") % len(bad)))).otherwise("nice day all").alias("text"),
        (F.col("id") % 8 == 0).cast("int").alias("toxic"))
    seen = []
    counted = toxicity.counted
    try:
        toxicity.counted = lambda r, chars: seen.append(r.count()) or counted(r, chars)
        model = toxicity.fit(rows)
    finally:
        toxicity.counted = counted
    assert seen == [24_000, 24_000]
    assert all(model.score(f"you {w}") > 0.9 for w in bad) and model.score("nice day all") < 0.1


def test_toxicity_bounds_leave_the_weights_as_they_are(spark):
    """Bounds from the toxic texts and a part of the others drop no feature: the weights are those of a count of all, also where too many are likely."""
    draw = random.Random(8)
    common = [f"{a}{b}{c}" for a in ("bar", "lim", "ton", "ver") for b in ("ka", "do", "mi") for c in ("st", "rd", "l")]
    rows = [(i, " ".join(draw.choices(common, k=12)) + (f" {draw.choice(['grubmol', 'zwackig'])} v e x l o" if i % 5 == 0 else " vexing"), int(i % 5 == 0)) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    sizes, tallied = [], toxicity.tallied
    try:
        toxicity.tallied = lambda r, of: sizes.append(r.count()) or tallied(r, of)
        model = toxicity.fit(table)
        few = toxicity.fit(table, max_features=5)
    finally:
        toxicity.tallied = tallied
    assert 300 < sizes[1] < 700 and sizes[0] == sizes[2] == 1500  # all features are counted in a part only
    size = {0: 1200, 1: 300}
    seen: dict[str, list[int]] = {}
    found = toxicity.all_features(model.chars)
    for _, text, toxic in rows:
        for f in found(text):
            seen.setdefault(f, [0, 0])[toxic] += 1
    expected = {}
    for f, (n0, n1) in seen.items():
        gain = np.log((n1 + 0.5) / 301) - np.log((n0 + 0.5) / 1201)
        both = (n0 + n1) / 1500
        z = (n1 / 300 - n0 / 1200) / np.sqrt(both * (1 - both + 1e-9) * (1 / 300 + 1 / 1200))
        if n1 >= 8 and z >= 6 and gain >= 2.5:
            expected[f] = (gain, z)
    assert set(model.weights) == set(expected) and "=grubmol" in expected
    assert all(abs(model.weights[f] - expected[f][0]) < 1e-9 for f in expected)
    assert list(few.weights) == sorted(expected, key=lambda f: (-round(expected[f][1], 9), f))[:5]


def test_toxicity_counts_all_features_of_all_texts(spark):
    """Rare and harmless features too are counted in every text, of either label."""
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["stone", "stones", "v e x l o", "gr8t", "ünï", "a"], k=6)) + f" only{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(160)] + [None, ""]
    rows = [(i, text, int(i % 4 == 0)) for i, text in enumerate(texts)]
    got, tallied = [], toxicity.tallied

    def noted(r, of):
        found = tallied(r, of)
        got.append([tuple(x) for x in found.collect()])
        return found

    try:
        toxicity.tallied = noted
        model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3))
    finally:
        toxicity.tallied = tallied
    expected: dict[str, list[int]] = {}
    for _, text, toxic in rows:
        for f in toxicity.all_features(model.chars)(text or ""):
            expected.setdefault(f, [0, 0])[toxic] += 1
    counts: dict[str, list[int]] = {}
    for f, n0, n1 in (x for part in got[1:] for x in part):
        pair = counts.setdefault(f, [0, 0])
        pair[0] += n0
        pair[1] += n1
    assert counts == expected and counts["=onlyba"] == [1, 0] and counts["=stone"][0] > 50


def test_pieces_counted_as_numbers(monkeypatch):
    """Packed counts equal counts of sets, over several rounds and where characters are too many to pack."""
    draw = random.Random(4)
    letters = "abß" * 30 + "éжあ𝒳"
    texts = [{"".join(draw.choices(letters, k=draw.choice([1, 2, 3, 4, 5, 9, 70]))) for _ in range(draw.randrange(12))} for _ in range(300)]
    wide = [{chr(0x4E00 + (7 * i + k) % 3000) * 2 + "ab" for k in range(9)} for i in range(300)]
    monkeypatch.setattr(toxicity, "LETTERS_AT_ONCE", 400)
    monkeypatch.setattr(toxicity, "MOST_HELD", 900)
    for many in (texts, texts + wide, wide, [set()], []):
        tally, rows = toxicity.PieceTally(lambda words: words), []
        expected: dict[str, list[int]] = {}
        for k, words in enumerate(many):
            tally.add(k % 2, words)
            if tally.full():
                rows += tally.taken()
            for f in set().union(*map(toxicity.features, words)):
                expected.setdefault(f, [0, 0])[k % 2] += 1
        counts: dict[str, list[int]] = {}
        for f, n0, n1 in (x for r in rows + tally.taken() for x in zip(*(c.to_pylist() for c in r.columns))):
            pair = counts.setdefault(f, [0, 0])
            pair[0] += n0
            pair[1] += n1
        assert counts == expected
    assert tally.taken() == []


def test_perhaps_among_keeps_every_row_of_the_keys(spark):
    """No row of a join is lost, of numbers or texts, repeated, negative or missing; nearly all others go; two types are left to the join."""
    docs = spark.range(-3000, 3000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    docs = docs.unionAll(docs.where("doc_id % 10 = 0"))
    keys = docs.where("doc_id % 7 = 0 OR doc_id IS NULL").select("doc_id", F.lit(1).alias("toxic"))
    for kind in ("bigint", "string"):
        d, k = (x.withColumn("doc_id", F.col("doc_id").cast(kind)) for x in (docs, keys))
        kept = perhaps_among(d, k, "doc_id")
        assert kept.columns == d.columns and kept.count() < 1000
        assert sorted(map(tuple, kept.join(k, "doc_id").collect())) == sorted(map(tuple, d.join(k, "doc_id").collect()))
    other = keys.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert perhaps_among(docs, other, "doc_id").count() == docs.count()
    assert perhaps_among(docs, keys.limit(0), "doc_id").count() == 0


def test_texts_become_python_objects_in_slices(spark):
    """A batch of many long texts is worked on a slice at a time, with the same rows."""
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of row"), F.col("id").cast("string")).alias("text")).coalesce(1)
    sizes = over_batches(docs, lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long", 500)
    assert sorted(r[0] for r in sizes.collect()) == [300, 500, 500]
    assert over_batches(docs, lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long").collect()[0][0] == 1300
    taken, one = [], minhash.over_batches
    try:
        minhash.over_batches = lambda df, make, schema, rows=None: taken.append(rows) or one(df, make, schema, rows)
        found = minhash.classes(docs, size=2).collect()
    finally:
        minhash.over_batches = one
    assert len(found) == 1300 and taken.count(minhash.AT_ONCE) >= 3
