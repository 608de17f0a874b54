"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import binary, codes, counts, ctw, decontam, licenses, minhash, negatives, packing, pii, quality, toxicity, urls
from millrace.llm.common import crc_part, load, perhaps_among

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
COUNTED_BY = "byte_bpe_50k.json"
# fixed values: the rules of the query on URLs
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def query(key: str, sql: str | None = None):
    def add(run):
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


@query("op1_license_scan", licenses.sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(load(spark, folder, "documents"))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(load(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(load(spark, folder, "documents"))
    base = pii.KINDS[:4]
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    # find() lists spans by kind, then start
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    # a second parameter would be taken for the place in the array
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*base))), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op5_lm_scores")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    part = crc_part(F.col("doc_id"), 5)
    return ctw.score(load(spark, folder, "documents"), part != 1).withColumn("held_out", part == 1)


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return binary.round_trip(load(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(load(spark, folder, "pages"), URL_RULES)


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    """Fitted on labelled documents whose crc32 leaves them for training."""
    labels = load(spark, folder, "labels").select("doc_id", "toxic").where(crc_part(F.col("doc_id"), 3) != 1)
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return toxicity.fit(perhaps_among(docs, labels, "doc_id").join(labels, "doc_id"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(load(spark, folder, "documents"), toxicity_model(spark, folder))
    return scored.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.classes(load(spark, folder, "documents"), size=2, threshold=0.8)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rules(load(spark, folder, "documents")).drop("lang")


@query("op11_vector_codes", codes.sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codes.compress(load(spark, folder, "embeddings"))
    code = F.concat_ws("", F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")))
    found = codes.with_label_error(coded.select("vec_id", "label", code.alias("code"), "error"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op12_hard_negatives", negatives.sql("vec_id % 100 = 0", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_token_counts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return counts.count_tokens(load(spark, folder, "documents"), public_tokenizers.path(COUNTED_BY))
