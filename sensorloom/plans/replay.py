"""Version-pinned replay of stored batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timing import utc
from sensorloom.operators.aggregate import COUNTS, rollup_replays
from sensorloom.operators.work import overlapping_batches, replay_runs
from sensorloom.plans.process import Processed, attempt_number, empty_attempts, process_batches
from sensorloom.rules import ReplayRequest, mapping_rules, quality_rules
from sensorloom.runtime import materialize


@dataclass(frozen=True)
class Replayed:
    result: Processed
    replay_batches: DataFrame
    runs: DataFrame


def replay(
    request: ReplayRequest,
    manifests: DataFrame,
    obs: DataFrame | Callable[[DataFrame], DataFrame],
    canonical_prior: DataFrame,
    processed_at: Column,
    positions_prior: DataFrame | None = None,
    digests: DataFrame | None = None,
) -> Replayed:
    """Process the exact requested event interval again under the pinned versions.

    ``obs`` holds the stored observations, or is a function that reads those of the
    selected batches only. Only new ids become canonical, so repeating a replay adds nothing. Manifests are
    never changed. Every selected batch gets an attempt: without a row inside the interval one that
    counts nothing, and a failed one if it is not in the store or cannot be processed, which fails
    the run too. ``digests`` of the stored objects are verified against the manifests' checksums.
    """
    request.check()
    kept = ["batch_id", "facility_id", "collector_id", "received_at", "processing_attempt_count", "checksum"]
    selected = materialize(
        overlapping_batches(manifests, [request]).select("replay_id", *[c for c in kept if c in manifests.columns]),
        "replay-batches",
    )
    read = obs if callable(obs) else lambda batches: obs.join(batches.select("batch_id"), "batch_id", "left_semi")
    wanted = read(selected)
    # rows without an item or event time stay in, so that their batch fails instead of vanishing
    unplaced = F.col("item_order").isNull() | F.col("observed_at").isNull()
    low, high = F.lit(utc(request.from_time)), F.lit(utc(request.to_time))
    inside = wanted.where(unplaced | (F.col("observed_at") >= low) & (F.col("observed_at") < high))
    result = process_batches(
        inside,
        mapping_rules(request.mapping_version),
        quality_rules(request.quality_rules_version),
        manifests=selected,
        canonical_prior=canonical_prior,
        positions_prior=positions_prior,
        processed_at=processed_at,
        replay_id=request.replay_id,
        digests=digests,
    )
    attempts = materialize(result.attempts, "attempts")
    untried = materialize(selected.join(attempts.select("batch_id"), "batch_id", "left_anti"), "untried")
    # only batches without a row inside are looked for in the store again
    stored = untried.select("batch_id").limit(0) if untried.isEmpty() else read(untried).where("batch_id is not null").select("batch_id").distinct()
    untried = untried.join(stored.withColumn("_stored", F.lit(True)), "batch_id", "left")
    untried = untried.select(
        "batch_id", "replay_id", F.lit(request.mapping_version).alias("mapping_version"),
        F.lit(request.quality_rules_version).alias("quality_rules_version"), attempt_number(untried), "_stored",
        F.sha2(F.concat_ws("|", "batch_id", "replay_id", F.unix_micros(processed_at).cast("string")), 256).alias("processing_attempt_id"),
    )
    missing = F.lit("Stored raw object is missing")
    attempts = attempts.unionByName(
        empty_attempts(untried.where("_stored"), "COMPLETED", processed_at, F.lit(None))
    ).unionByName(empty_attempts(untried.where("_stored is null"), "FAILED", processed_at, missing))
    result = replace(result, attempts=attempts)
    counted = attempts.where("batch_id is not null").select("batch_id", "total_count", "status", "last_error", *COUNTS)
    batches = selected.join(counted, "batch_id").select(
        "replay_id", "batch_id", "status", F.col("total_count").alias("processed_observation_count"), *COUNTS, "last_error"
    )
    matching = batches.groupBy("replay_id").agg(F.count(F.lit(1)).alias("matching_batch_count"))
    runs = replay_runs(manifests.sparkSession, [request]).join(matching, "replay_id", "left").select(
        "*", *[F.lit(0).cast("long").alias(c) for c in ("processed_observation_count", *COUNTS)],
    )
    runs = runs.withColumn("matching_batch_count", F.coalesce("matching_batch_count", F.lit(0))).withColumn(
        "status", F.when(F.col("matching_batch_count") == 0, F.lit("COMPLETED")).otherwise(F.lit("PENDING"))
    )
    ended = F.when(F.col("status").isin("COMPLETED", "FAILED"), processed_at)
    runs = rollup_replays(runs, batches).withColumns({"started_at": processed_at, "completed_at": ended})
    return Replayed(result, batches, runs)
