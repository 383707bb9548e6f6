"""One query for each operator of this package, with comparison SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import (
    bpe,
    decontamination,
    embeddings,
    language,
    language_model,
    lexical,
    licenses,
    line_dedup,
    negatives,
    passages,
    quality,
    simhash,
    topk,
)
from sensorloom.llm.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_cut_lines").alias("n_cut_lines"),
        F.col("_n_cut_chunks").alias("n_cut_chunks"), F.md5("text").alias("text_md5"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its source's directory for its language."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.substring_index("path", "/", -1).cast("long"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.noisy_labels(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_bpe, op3_simhash, op4_language_id, op5_lm_scoring, op6_embedding_dedup,
        op7_substring_dedup, op8_quality_classifier, op9_decontamination, op10_license_scan,
        op11_topk, op12_lexical_search, op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op5_lm_scoring": language_model.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
    "op11_topk": topk.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
