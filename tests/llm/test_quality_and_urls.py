"""Quality rules and URL verdicts against plain Python: all columns, missing values, repeated rows, other columns."""

from __future__ import annotations

import math
import random
import re

import pytest

from millrace.llm import quality, urls

BLANK = re.compile("[ \t\n\x0b\f\r]+")
CLASSES = [re.compile(p) for p in ("[a-z]", "[ \t\n\x0b\f\r]", "[A-Z]", "[0-9]", "[#*$%&|<>]", "[.,]", "[!?;:'\"()-]", "[\x80-\U0010ffff]", "(?s).")]


def counts(text: str, lang: str | None) -> dict:
    words = [w for w in BLANK.split(text) if w]
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + i for places in windows.values() if len(places) > 1 for k in places for i in range(5)}
    classes = [0] * 9
    for c in text:
        classes[next(k for k, p in enumerate(CLASSES) if p.fullmatch(c))] += 1
    own = quality.COMMON.get(lang or "")
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "classes": classes, "common": [words.count(w) for w in own] if own else [],
    }


def shares(numbers: list[int], least: int) -> list[float] | None:
    n = sum(numbers)
    return [x / n for x in numbers] if n >= least and n else None


def divergence(p, r) -> float | None:
    if p is None or not r:
        return None
    mean = [(a + b) / 2 for a, b in zip(p, r)]
    total = sum(a * math.log2(a / m) / 2 for x in (p, r) for a, m in zip(x, mean) if a > 0)
    return math.sqrt(max(total, 0.0))


def texts():
    draw = random.Random(12)
    english, german = quality.COMMON["en"], quality.COMMON["de"]
    rows: list[tuple] = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        body = draw.choices(quality.COMMON[lang], k=60) + draw.choices(["Haus", "walks", "garden", "12", "x-ray", "été."], k=40)
        draw.shuffle(body)
        rows.append((k, "\n".join(" ".join(body[a : a + 12]) for a in range(0, len(body), 12)), lang))
    rows += [(100, " ".join(["the"] * 40 + [f"w{k}" for k in range(60)]), "en"), (101, "#$%& 99 <> " * 4 + " ".join(f"{k}|{k}" for k in range(80)), "en")]
    rows += [(102, None, "en"), (103, "", None), (104, "no language " + rows[0][1], None), (105, rows[1][1], "xx"), (106, " \n\n \x0b", "de"), (107, "one two three", "en")]
    rows += [(108, "a b c d e f g a b c d e f g a b c d e", "en"), (109, "same line\nsame line\n\n \nsame line\nÜ \U0001f600 ß", "de"), (0, rows[0][1], "en"), (None, rows[3][1], "de")]
    rows += [(110, "long text of words " * 3000, "en"), (111, " ".join(draw.choices(german, k=50)) + " wrong language", "en"), (112, " ".join(draw.choices(english, k=9)), "en")]
    return rows


def test_every_column_of_the_quality_rules(spark):
    rows = texts()
    measured = [counts(t or "", lang) for _, t, lang in rows]
    parts = [(shares(m["classes"], quality.MIN_CHARS), shares(m["common"], quality.MIN_COMMON)) for m in measured]
    reference: dict[str, tuple] = {}
    for lang in {r[2] or "" for r in rows}:
        own = [[p[k] for p, r in zip(parts, rows) if (r[2] or "") == lang and p[k] is not None] for k in (0, 1)]
        reference[lang] = tuple([sum(x) / len(group) for x in zip(*group)] if group else None for group in own)
    want = {}
    for (i, t, lang), m, p in zip(rows, measured, parts):
        far = [divergence(p[k], reference[lang or ""][k]) for k in (0, 1)]
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        kept = not failed and not (far[0] or 0) > quality.MAX_CLASS_DISTANCE and not (far[1] or 0) > quality.MAX_WORD_DISTANCE
        want[i, t, lang] = (*(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept, *far)
    docs = spark.createDataFrame([(*r, 7, "mine") for r in rows], "doc_id long, text string, lang string, words int, classes string")
    got = quality.rules(docs).collect()
    assert len(got) == len(rows)
    by_id = {i: w for (i, *_), w in want.items()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r in got:
        w = by_id[r["doc_id"]]
        assert tuple(r[n] for n in names) == w[:7], r
        assert [r["class_distance"], r["word_distance"]] == [None if x is None else pytest.approx(x, abs=1e-9) for x in w[7:]], r
    assert {by_id[k][6] for k in range(60)} == {True} and not by_id[101][6] and not by_id[110][6]


def test_urls_of_every_kind(spark):
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/"), ("allow", "deep.example.org/es/ok"))
    names = [None, "", "no scheme", "://", "http://", "HTTP://A.B.ORG", "x://ORG?q=/es/", "x://org#/es/", "x://notorg/", "a://example.org/es/1?x#y", "a://example.org/es", "a://deep.example.org/es/ok/2", "p://q://r.org/", "x://com/de/", "x://a.com/DE/", "x://e.com/de/\nz", "u://é.org/ü"]
    rows = [(k, x, "mine", 1) for k, x in enumerate(names)] + [(9, names[9], "again", 2), (None, names[9], "", 3)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score int"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        url = names[r["page_id"] if r["page_id"] is not None else 9] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        found = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]
        fits = [(len(t), v, t) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[2] if fits else None), url
        assert r["verdict"] == (max(fits)[1] if fits else "block" if r["score"] >= 0.5 else "allow")
        assert 0 <= r["score"] <= 1
    assert len({r["score"] for r in got if not r["host"] and not r["path"]}) == 1
    none = spark.createDataFrame(rows, "page_id long, url string, host string, score int").limit(0)
    assert urls.judge(none, rules).collect() == []


def test_verdicts_of_addresses_without_a_rule(spark):
    """Pages without a rule are judged by what rules say of pages with the same n-grams; held-out accuracy."""
    draw = random.Random(2)
    bad, good = ["casino", "pills", "jackpot"], ["garden", "library", "museum"]
    name = lambda words: f"{draw.choice(words)}{draw.randrange(100)}-{draw.choice(words)}"
    rows = [(k, f"http://{name(bad)}.com/de/{name(bad)}" if k % 2 else f"http://{name(good)}.org/{name(good)}") for k in range(300)]
    rows += [(1000 + k, f"http://{name(bad if k % 2 else good)}.net/{name(bad if k % 2 else good)}") for k in range(100)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (("allow", "org/"), ("block", "com/de/")))
    judged = {r["page_id"]: r["verdict"] for r in got.where("rule IS NULL").collect()}
    assert len(judged) == 100
    assert sum(v == ("block" if k % 2 else "allow") for k, v in judged.items()) >= 97
