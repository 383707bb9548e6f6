"""Canonical documents and batch or replay inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import schemas


def to_canonical_document(samples: DataFrame) -> DataFrame:
    """Flat canonical rows to one nested ``document`` struct per row."""
    source = F.struct(
        F.col("source_system").alias("sourceSystem"),
        F.col("source_epoch").alias("sourceEpoch"),
        F.col("source_sequence").alias("sourceSequence"),
        F.col("source_tag").alias("sourceTag"),
        F.col("collector_id").alias("collectorId"),
        F.col("collector_version").alias("collectorVersion"),
        F.col("mapping_version").alias("mappingVersion"),
        F.col("quality_rules_version").alias("qualityRulesVersion"),
    )
    return samples.select(
        F.struct(
            F.lit(schemas.SAMPLE_CONTRACT).alias("contractVersion"),
            F.col("observation_id").alias("observationId"),
            F.col("facility_id").alias("facilityId"),
            F.col("asset_id").alias("assetId"),
            F.col("signal_id").alias("signalId"),
            F.col("observed_at").alias("observedAt"),
            F.col("received_at").alias("receivedAt"),
            F.col("processed_at").alias("processedAt"),
            "value",
            "unit",
            "quality",
            "flags",
            source.alias("source"),
        ).alias("document")
    )


def documents_as_json(samples: DataFrame) -> DataFrame:
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return to_canonical_document(samples).select(F.to_json("document", options).alias("json"))


def _only(df: DataFrame, key: str, ids: list[str] | None) -> DataFrame:
    return df if ids is None else df.where(F.col(key).isin(ids))


def _section(df: DataFrame, key: str, section: str, rank: int, at: str, newest_first: bool) -> DataFrame:
    micros = F.unix_micros(at)
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    return df.select(
        key, F.lit(section).alias("section"), F.lit(rank).alias("section_rank"),
        F.col(at).alias("at"), F.coalesce(-micros if newest_first else micros, F.lit(0)).alias("position"),
        body.alias("detail"),
    )


def inspect_batches(
    manifests: DataFrame, attempts: DataFrame, rejections: DataFrame, ids: list[str] | None = None
) -> DataFrame:
    """Manifest, then attempts newest first, then rejections oldest first, per batch.

    One row per line instead of one array per batch, so no batch is gathered in a task;
    the final sort is a range shuffle.
    """
    parts = [
        _section(_only(manifests, "batch_id", ids), "batch_id", "manifest", 0, "received_at", False),
        _section(_only(attempts, "batch_id", ids), "batch_id", "attempt", 1, "started_at", True),
        _section(_only(rejections, "batch_id", ids), "batch_id", "rejection", 2, "created_at", False),
    ]
    listed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return listed.orderBy("batch_id", "section_rank", "position", "detail").drop("position")


def inspect_replays(runs: DataFrame, replay_batches: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Run, then its batches by batch id, per replay."""
    head = _section(_only(runs, "replay_id", ids), "replay_id", "run", 0, "requested_at", False)
    batches = _only(replay_batches, "replay_id", ids).withColumn("_at", F.lit(None).cast("timestamp"))
    lines = _section(batches, "replay_id", "batch", 1, "_at", False)
    head = head.withColumn("batch_id", F.lit(None).cast("string"))
    lines = lines.withColumn("batch_id", F.get_json_object("detail", "$.batch_id"))
    return head.unionByName(lines).orderBy("replay_id", "section_rank", "batch_id").drop("position")
