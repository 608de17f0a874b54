"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Features are the character n-grams (3 to 5) of host and path, hashed into a fixed number of buckets, so
the model's size does not depend on the data. It is fitted on a small labelled URL table: at most
``max_labelled`` rows, the ones whose address hashes lowest.

A missing URL, or one without "://", has an empty host and path; no rule fits it and the model judges
the empty text. Repeated rows get the same verdict. With no labels, or labels of one class only, there
is nothing to learn and every score is that class's (0, allow, without labels). An empty table gives an
empty one; only the id and the URL are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import ascii_lower

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000
MAX_RULES = 1_000

Rule = tuple[str, str]  # verdict, host and path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, or NULL. A rule's host fits itself and its subdomains, its path the start of the path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} go into one expression")
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):  # later ones, the longer, come out on top
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def grams(text: Column) -> Column:
    """All n-grams of each size; a shorter text is one gram of its own."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.concat(*(of(n) for n in SIZES))


def hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True).transform(df.withColumn("grams", grams(F.concat("host", "path"))))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, seed_columns: Sequence[str] = ("host", "path")):
    """A model from ``host``, ``path`` and ``label`` (1: block), or the one class as a number if there is only one."""
    rows = labelled.select("host", "path", F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    rows = rows.groupBy("host", "path", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")).persist()
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).orderBy("n", "label").collect()
    if len(sizes) < 2:
        rows.unpersist()
        return float(sizes[0]["label"]) if sizes else 0.0
    left, parts, kept = max_labelled, [], [rows]
    for k, size in enumerate(sizes):  # the smaller class first
        own = rows.where(F.col("label") == size["label"])
        take = min(size["n"], left // (len(sizes) - k))
        left -= take
        if take < size["n"]:
            own = own.orderBy(F.xxhash64(*seed_columns), *seed_columns).limit(take).persist()
            kept.append(own)
            held = own.agg(F.sum("weight")).first()[0] or 1.0
            own = own.withColumn("weight", F.col("weight") * (size["weight"] / held))
        parts.append(own)
    sample = hashed(reduce(DataFrame.unionByName, parts)).select("features", "label", "weight").persist()
    model = LogisticRegression(maxIter=60, regParam=1e-3, weightCol="weight").fit(sample)
    for used in (*kept, sample):
        used.unpersist()
    return model


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the model's, for every row).

    ``labelled`` has columns ``url`` and ``label`` (1: block). Without it the rows that rules decide are
    the labels.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([text for verdict, text in rules if verdict == "block"])
    if labelled is None:
        known = rows.where("rule IS NOT NULL").withColumn("label", blocked.cast("int"))
    else:
        known = labelled.select(host_of(url).alias("host"), path_of(url).alias("path"), "label")
    model = fit(known)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(hashed(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("rule").isNull(), F.col("score") >= threshold).otherwise(blocked)
    return scored.select("page_id", "host", "path", "rule", F.when(verdict, "block").otherwise("allow").alias("verdict"), "score")

