"""Collector fleet: latest heartbeats, inventory, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timing import floor_seconds

# Fixed value: a collector is offline after this many seconds without a heartbeat.
OFFLINE_SECONDS = 90


def latest_heartbeats(heartbeats: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Last write per collector with its status; combined before the shuffle."""
    rest = [c for c in heartbeats.columns if c not in ("collector_id", "received_at", *tie_break)]
    newest = heartbeats.groupBy("collector_id").agg(
        F.max(F.struct("received_at", *tie_break, *rest)).alias("_last")
    )
    return newest.select(
        "collector_id", F.col("_last.received_at").alias("last_heartbeat"),
        *[F.col(f"_last.{c}").alias(c) for c in rest],
        F.when(F.col("_last.source_connected"), F.lit("ONLINE")).otherwise(F.lit("SOURCE_DISCONNECTED")).alias(
            "current_status"
        ),
    )


def collector_inventory(status: DataFrame, now: Column, collector_id: str | None = None) -> DataFrame:
    """Status at read time: a collector with an old heartbeat is ``OFFLINE``."""
    kept = status if collector_id is None else status.where(F.col("collector_id") == collector_id)
    silent = F.unix_micros("last_heartbeat") < F.unix_micros(now) - OFFLINE_SECONDS * 1_000_000
    return kept.withColumn(
        "current_status", F.when(silent, F.lit("OFFLINE")).otherwise(F.col("current_status"))
    ).orderBy("collector_id")


def fleet_gauges(status: DataFrame, now: Column) -> DataFrame:
    return status.agg(
        F.max("last_heartbeat").alias("_last"),
        F.coalesce(F.sum("spool_observation_count"), F.lit(0)).alias("spool_observations"),
        F.coalesce(F.max("oldest_unsent_observation_age_seconds"), F.lit(0)).alias("oldest_unsent_age_seconds"),
    ).select(
        F.when(F.col("_last").isNull(), F.lit(float("inf")))
        .otherwise(F.greatest(floor_seconds(now, F.col("_last")), F.lit(0)).cast("double"))
        .alias("heartbeat_age_seconds"),
        "spool_observations",
        "oldest_unsent_age_seconds",
    )
