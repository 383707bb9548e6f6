"""Small helpers that every operator of this package shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session that sends Python at most ``BATCH_BYTES`` at a time, however long the texts are."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, ready for Python."""
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fraction_of(column: Column) -> Column:
    """A number in [0, 1) that depends on the value alone: picks the same rows in every run."""
    return F.pmod(F.xxhash64(column.cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
