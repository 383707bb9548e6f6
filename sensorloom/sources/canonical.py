"""Canonical and rejection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import schemas

PARTITION = "observed_date"


def write_canonical(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Store samples by event day, sorted for range pruning inside each file.

    The rebalance splits a day that holds much of the data over several tasks and
    merges small ones.
    """
    dated = samples.select(*schemas.CANONICAL_COLUMNS).withColumn(PARTITION, F.to_date("observed_at"))
    (
        dated.hint("rebalance", PARTITION)
        .sortWithinPartitions(PARTITION, "facility_id", "asset_id", "signal_id", "observed_at")
        .write.partitionBy(PARTITION)
        .mode(mode)
        .parquet(path)
    )


def write_rejections(rejections: DataFrame, path: str, mode: str = "append") -> None:
    """Store rejections by creation day, sorted by batch."""
    dated = rejections.select(*schemas.REJECTION_COLUMNS).withColumn("date", F.to_date("created_at"))
    (
        dated.hint("rebalance", "date")
        .sortWithinPartitions("date", "batch_id")
        .write.partitionBy("date")
        .mode(mode)
        .parquet(path)
    )


def quarantine_report(rejections: DataFrame) -> DataFrame:
    """Rejections per batch and reason."""
    return rejections.groupBy("batch_id", "reason_code").agg(
        F.count(F.lit(1)).alias("rejections"), F.min("created_at").alias("first_created_at")
    )
