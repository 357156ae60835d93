"""The queries of this subpackage, with their production parameters, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm_scoring, ngram_jaccard, packing, quality, secret_scans, token_output, topk_search, toxicity, url_filters
from .shared import crc_remainder, new_folder, table

RULES = [
    url_filters.rule("block", "net/"),
    url_filters.rule("allow", "example.net/en/"),
    url_filters.rule("block", "example.com/de/"),
    url_filters.rule("allow", "org/fr/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", crc_remainder(F.col("id"), 3) != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), out)
    return token_output.read_tokens(spark, out).drop("ids")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), lm_scoring.trained_on())
    return scored.withColumn("held_out", ~lm_scoring.trained_on()).drop("n_bytes")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", crc_remainder(F.col("id"), 5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_ngram_jaccard, op4_topk_search, op5_token_output, op6_lm_scoring, op7_url_filters, op8_packing, op9_quality, op10_secret_scans)}
