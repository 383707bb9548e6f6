"""Structured Streaming ingest with effects that repeat safely.

Every micro-batch writes to folders named by its id in overwrite mode, so a retried
micro-batch replaces its own output and never reads it as history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators.identity import merge_rejections
from sensorloom.operators.order import flag_out_of_order, merge_positions, source_positions
from sensorloom.operators.validate import validate_batches
from sensorloom.plans.process import empty_attempts, process_batches, with_receipts
from sensorloom.rules import MappingRules, QualityRules
from sensorloom.runtime import materialize, scratch_scope
from sensorloom.sources.canonical import write_canonical, write_rejections
from sensorloom.sources.raw import STORED_BATCH, explode_observations, json_options

MICRO_BATCH = "micro_batch"
KEPT_POSITIONS = 3
AVAILABLE_NOW = {"availableNow": True}


def read_before(spark: SparkSession, path: str, micro_batch: int | None = None) -> DataFrame | None:
    """Stored output of earlier micro-batches, or null when there is none."""
    try:
        stored = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return stored if micro_batch is None else stored.where(F.col(MICRO_BATCH) < micro_batch)


def carried_positions(spark: SparkSession, out: str, micro_batch: int) -> DataFrame | None:
    """Source positions after the previous micro-batch: one row per source key."""
    try:
        return spark.read.parquet(f"{out}/positions/{MICRO_BATCH}={micro_batch - 1}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    earlier = read_before(spark, f"{out}/positions", micro_batch)
    return None if earlier is None else merge_positions(earlier.drop(MICRO_BATCH))


def save_positions(positions: DataFrame, out: str, micro_batch: int) -> None:
    """Keep the positions after this micro-batch and of the one before, which a retry needs."""
    positions.write.mode("overwrite").parquet(f"{out}/positions/{MICRO_BATCH}={micro_batch}")
    session = positions.sparkSession
    old = session._jvm.org.apache.hadoop.fs.Path(f"{out}/positions/{MICRO_BATCH}={micro_batch - KEPT_POSITIONS}")
    old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)


def rejections_before(spark: SparkSession, out: str, micro_batch: int, attempts: DataFrame) -> DataFrame | None:
    """Recorded rejections of the batches in ``attempts``; read only if one was attempted before."""
    tried = read_before(spark, f"{out}/attempts", micro_batch)
    if tried is None:
        return None
    again = materialize(tried.select("batch_id").join(attempts.select("batch_id"), "batch_id", "left_semi").distinct(), "again")
    if again.isEmpty():
        return None
    recorded = read_before(spark, f"{out}/rejections", micro_batch)
    return None if recorded is None else recorded.join(again, "batch_id", "left_semi")


def refused_attempts(refused: DataFrame, mapping: MappingRules, quality: QualityRules) -> DataFrame:
    """A failed attempt that counted nothing for each refused batch with an id."""
    at = F.current_timestamp()
    rows = refused.where("batchId is not null").select(F.col("batchId").alias("batch_id")).distinct().select(
        "batch_id", F.lit(None).cast("string").alias("replay_id"), F.lit(mapping.version).alias("mapping_version"),
        F.lit(quality.version).alias("quality_rules_version"), F.lit(1).alias("attempt_number"),
        F.sha2(F.concat_ws("|", "batch_id", F.lit("live"), F.unix_micros(at).cast("string")), 256).alias("processing_attempt_id"),
    )
    return empty_attempts(rows, "FAILED", at, F.lit("Stored raw batch violates the worker envelope limits"))


def raw_batch_stream(spark: SparkSession, root: str, multiline: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STORED_BATCH).options(**json_options(multiline))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(root)


def stream_process(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    out: str,
    mapping: MappingRules,
    quality: QualityRules,
    manifests: Callable[[], DataFrame],
    processed_at: Column,
    multiline: bool = False,
    files_per_trigger: int | None = None,
    trigger: dict | None = None,
    digests: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Process new raw files under ``root`` into ``out``/canonical, rejections, outcomes, attempts, positions.

    Batches with an invalid envelope go to ``out``/refused and, where they have an id, get a failed attempt.
    ``digests`` (batch_id, checksum) of the stored objects are verified against the manifests. ``manifests`` is read anew for each micro-batch and gives the receipt times.
    ``processed_at`` may use the columns of an observation. Files must arrive in
    receipt order between micro-batches; within one the arrival order is restored.
    """

    def effect(batch: DataFrame, micro_batch: int) -> None:
        with scratch_scope(batch.sparkSession):
            process(batch, micro_batch)

    def process(batch: DataFrame, micro_batch: int) -> None:
        session = batch.sparkSession
        folder = lambda name: f"{out}/{name}/{MICRO_BATCH}={micro_batch}"
        checked = materialize(validate_batches(batch), "checked")
        refused = checked.where(F.col("reason_code").isNotNull())
        refused.select("batchId", "collectorId", "facilityId", "reason_code").write.mode("overwrite").parquet(folder("refused"))
        sound = checked.where(F.col("reason_code").isNull())
        carried = carried_positions(session, out, micro_batch)
        history = lambda: read_before(session, f"{out}/canonical", micro_batch)
        done = process_batches(
            explode_observations(with_receipts(sound, manifests(), digests and digests())),
            mapping,
            quality,
            canonical_prior=None if carried is None else history,
            positions_prior=carried,
            processed_at=processed_at,
        )
        recorded = rejections_before(session, out, micro_batch, done.attempts)
        write_canonical(done.canonical, folder("canonical"), mode="overwrite")
        write_rejections(merge_rejections(recorded, done.rejections), folder("rejections"), mode="overwrite")
        save_positions(done.positions, out, micro_batch)
        done.outcomes.write.mode("overwrite").parquet(folder("outcomes"))
        attempts = done.attempts.unionByName(refused_attempts(refused, mapping, quality))
        attempts.write.mode("overwrite").parquet(folder("attempts"))

    return (
        raw_batch_stream(spark, root, multiline, files_per_trigger)
        .writeStream.foreachBatch(effect)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def stream_order_state(
    accepted: DataFrame, checkpoint: str, out: str, order: list[str] | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Out-of-order flags on a stream of marked rows, with per-source maxima carried between micro-batches.

    The carried state is one small row per source key. A hot key is
    still cut into slices inside a micro-batch.
    """

    def effect(batch: DataFrame, micro_batch: int) -> None:
        with scratch_scope(batch.sparkSession):
            carried = carried_positions(batch.sparkSession, out, micro_batch)
            flagged = flag_out_of_order(batch, carried, order)
            flagged.write.mode("overwrite").parquet(f"{out}/flagged/{MICRO_BATCH}={micro_batch}")
            reached = source_positions(batch.where("is_canonical"))
            save_positions(reached if carried is None else merge_positions(carried, reached), out, micro_batch)

    return (
        accepted.writeStream.foreachBatch(effect)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
