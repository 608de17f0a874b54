"""Quality rules with SQL functions only: repetition rules and distribution divergence.

The base rule fails texts of fewer than ``MIN_WORDS`` words, or with more than a fifth of their words in
five-word windows that occur twice or more. The method compares a text with its language: the share of
each character class, and of each common word, against the reference of the language by Jensen-Shannon
distance. References are the average shares over all documents of the language, taken over texts long
enough to be judged. Texts shorter than the guards are not judged on that histogram; too divergent ones
are not kept.

A missing text counts as empty: no words, base rule failed. A missing language is a language of its own.
An empty table gives an empty one. Repeated rows are judged alike. Only the id, the text and the
language are read. Nothing of a text leaves its row: windows are found by sorting their hashes within
the row; only the sums of histograms, one row per language, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import written

MIN_WORDS = 10
WINDOW = 5
#: Least number of characters for the class histogram, and of common words for the word histogram.
MIN_CHARS, MIN_COMMON = 200, 30
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.75

# fixed values: frequent function words by language
COMMON = {
    "en": "the of and to in is it that for on with as was be by this are from or an".split(),
    "de": "der die das und zu den von mit ein eine nicht des auf im ist für dem sich in als".split(),
    "fr": "le la les de des un une et en est que qui dans pour sur par au du il elle".split(),
    "es": "el la los las de y que en un una por con no es para del se su al lo".split(),
}
#: Character classes as regular expressions, taken off a text one after the other; the rest counts as "other".
CLASSES = ("[a-z]+", "[ \\t\\n\\x0B\\f\\r]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,]+", "[!?;:'\"()-]+", "[\\x{80}-\\x{10FFFF}]+")
BLANK, SYMBOL = 1, 4
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"
A_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def windows_repeated(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: how many ``words`` lie in five-word windows that occur twice or more, the first included.

    Hashes of the windows are sorted together with their places, so equal windows are neighbours; the
    covered words are then counted from the sorted places of repeated windows. Every list is a column of
    its own because a list built inside a lambda would be built again for each element.
    """
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.slice("codes", 1, F.greatest(F.size("codes") - (WINDOW - 1), F.lit(0))),
        lambda c, i: F.struct(F.xxhash64(c, *(F.get("codes", i + k) for k in range(1, WINDOW))).alias("h"), i.alias("at")),
    )
    rows = rows.withColumn("ranked", F.array_sort(windows))
    same = lambda x, i, k: F.coalesce(x["h"] == F.get("ranked", i + k)["h"], F.lit(False))
    again = F.filter("ranked", lambda x, i: same(x, i, -1) | same(x, i, 1))
    places = F.array_sort(F.transform(again, lambda x: x["at"]))
    # places rise, so a running sum needs only the place before
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    step = lambda s, at: F.struct(at.alias("at"), (s["n"] + F.least(at - s["at"], F.lit(WINDOW))).alias("n"))
    return rows.withColumn("n_repeat_words", F.aggregate(places, start, step, lambda s: s["n"]).cast("bigint"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base counts and the two histograms. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("r0"))
    rows = rows.withColumn("words", F.filter(F.split("r0", WORD_GAP), lambda w: w != ""))
    lines = F.filter(F.split("r0", "\n"), lambda x: x.rlike(A_WORD))
    rows = rows.withColumn("lines", lines)
    for k, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"r{k + 1}", F.regexp_replace(f"r{k}", pattern, ""))
    size = [F.length(f"r{k}") for k in range(len(CLASSES) + 1)]
    classes = F.array(*(a - b for a, b in zip(size, size[1:])), size[-1])
    own = F.element_at(F.create_map(*(x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words))))), F.col("lang"))
    some = F.filter("words", lambda w: w.isin(sorted({w for words in COMMON.values() for w in words})))
    rows = windows_repeated(rows).select(
        "doc_id", "lang",
        F.size("words").cast("bigint").alias("n_words"),
        (size[0] - (size[BLANK] - size[BLANK + 1])).cast("bigint").alias("word_chars"),
        (size[SYMBOL] - size[SYMBOL + 1]).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        classes.alias("classes"), own.alias("own"), some.alias("some"),
    )
    counted = F.transform("own", lambda w: F.size(F.filter("some", lambda x: x == w)))
    counted = F.when(F.size("some") > 0, counted)
    return rows.withColumn("common", F.coalesce(counted, F.array().cast("array<int>"))).drop("own", "some")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda s, x: s + x)


def distance(p: Column, r: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, from 0 to 1."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, r, lambda a, b: (half(a, b) + half(b, a)) / 2)
    found = F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    return F.when(p.isNotNull() & r.isNotNull(), found)


def judge(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``class_distance``, ``word_distance`` and ``kept`` to what ``measures`` returns. Reads it twice."""
    chars, common = total(F.col("classes")), total(F.col("common"))
    shares = lambda counts, n, least: F.when(n >= least, F.transform(counts, lambda x: x / n))
    rows = measured.withColumns({"p": shares(F.col("classes"), chars, MIN_CHARS), "q": shares(F.col("common"), common, MIN_COMMON)})
    n = len(CLASSES) + 1
    widest = max(map(len, COMMON.values()))
    means = lambda name, n: F.array(*(F.avg(F.get(name, k)) for k in range(n)))
    reference = rows.groupBy("lang").agg(means("p", n).alias("p_ref"), F.filter(means("q", widest), lambda x: x.isNotNull()).alias("q_ref"))
    rows = rows.join(reference, "lang")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": base, "class_distance": distance(F.col("p"), F.col("p_ref")), "word_distance": distance(F.col("q"), F.col("q_ref"))})
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).drop("p", "q", "p_ref", "q_ref", "classes", "common")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Measure every document once, write the short rows, and judge them."""
    return judge(written(measures(docs, id_col, text_col, lang_col)))
