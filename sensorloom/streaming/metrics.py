"""Streaming outcome rates and fleet status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators.fleet import latest_heartbeats
from sensorloom.operators.aggregate import outcome_rates
from sensorloom.streaming import tiers
from sensorloom.streaming.ingest import AVAILABLE_NOW, MICRO_BATCH


def start_rates(
    outcomes: DataFrame, checkpoint: str, out: str, window: str, by: tuple[str, ...] = ("outcome",), trigger: dict | None = None
) -> StreamingQuery:
    """Write the counts that each micro-batch adds to its windows of processing time.

    Counts add up whenever they come, so no row is dropped for being late and no state is kept. The counts of
    earlier micro-batches are summed in tiers, so their number does not grow with that of the micro-batches.
    """
    combine = lambda stored: stored.groupBy("window_start", *by).agg(F.sum("observations").alias("observations"))

    def effect(batch: DataFrame, micro_batch: int) -> None:
        tiers.add(outcome_rates(batch, window, by).drop("per_second"), out, micro_batch, combine)

    return (
        outcomes.writeStream.foreachBatch(effect)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def read_rates(spark: SparkSession, out: str, window: str, by: tuple[str, ...] = ("outcome",), slide: str | None = None) -> DataFrame:
    """Counts and rates of all windows; with ``slide`` the stored windows are the panes of longer ones."""
    stored = tiers.read(spark, out).groupBy("window_start", *by).agg(F.sum("observations").alias("observations"))
    whole = F.window("window_start", window, slide) if slide else F.window("window_start", window)
    counted = stored.groupBy(whole.alias("_w"), *by).agg(F.sum("observations").alias("observations"))
    seconds = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / F.lit(1_000_000)
    return counted.select(
        F.col("_w.start").alias("window_start"), *by, "observations", (F.col("observations") / seconds).alias("per_second")
    )


def stream_heartbeats(
    heartbeats: DataFrame, checkpoint: str, out: str, tie_break: tuple[str, ...] = (), trigger: dict | None = None
) -> StreamingQuery:
    """Upsert the last heartbeat per collector; ``OFFLINE`` is decided when the status is read."""

    def effect(batch: DataFrame, micro_batch: int) -> None:
        latest = latest_heartbeats(batch, tie_break).withColumn(MICRO_BATCH, F.lit(micro_batch).cast("long"))
        tiers.add(latest, out, micro_batch, _last_writes)

    return (
        heartbeats.writeStream.foreachBatch(effect)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def _last_writes(stored: DataFrame) -> DataFrame:
    """One row per collector: the latest heartbeat, of equal ones that of the later micro-batch."""
    rest = [c for c in stored.columns if c != "collector_id"]
    return (
        stored.groupBy("collector_id")
        .agg(F.max_by(F.struct(*rest), F.struct("last_heartbeat", MICRO_BATCH)).alias("_last"))
        .select("collector_id", *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def read_fleet_status(spark: SparkSession, out: str) -> DataFrame | None:
    """One row per collector: the last write wins."""
    stored = tiers.read(spark, out)
    return None if stored is None else _last_writes(stored).drop(MICRO_BATCH)
