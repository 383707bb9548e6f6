"""Corpus preparation: five operators in a row, each stage written as Parquet and read by the next."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sensorloom.llm import bpe, decontamination, line_dedup, quality, simhash  # noqa: E402
from sensorloom.llm.queries import TOKENIZER  # noqa: E402
from sensorloom.llm.tables import table  # noqa: E402
from sensorloom.runtime import materialize  # noqa: E402


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go; every document stays, with what is left of its text."""
    cut = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("_n_cut_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoding."""
    return bpe.digests(docs, TOKENIZER)


STAGES = [
    ("quality", drop_bad),
    ("line_dedup", cut_repeated_lines),
    ("simhash", keep_one_near_duplicate),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The classifier is trained and the fingerprints hash with a function that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
