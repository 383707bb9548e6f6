"""From raw observations to canonical samples, rejections, outcomes and attempts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators.aggregate import COUNTS, batch_outcome_counts
from sensorloom.operators.evaluate import evaluate_observations, numeric_value
from sensorloom.operators.identity import Align, History, mark_canonical, merge_rejections, not_rejected
from sensorloom.operators.order import compare_with_earlier, merge_positions, raise_out_of_order, source_positions
from sensorloom.rules import MappingRules, QualityRules
from sensorloom.runtime import materialize
from sensorloom.schemas import DELIVERY, SOURCE_KEY, TOTAL_ARRIVAL

ERROR = "batch_error"
RECEIPT = ["received_at", "processing_attempt_count"]
#: What the checks of a batch need of each of its rows, where the input has it.
CHECKED = ["contract_version", "item_count", "digest_failed"]


@dataclass(frozen=True)
class Processed:
    """``positions`` are the source maxima after this run, to be stored beside the canonical table."""

    canonical: DataFrame
    rejections: DataFrame
    outcomes: DataFrame
    attempts: DataFrame
    positions: DataFrame


def decide(
    evaluated: DataFrame, canonical_prior: History | None = None, positions_prior: DataFrame | None = None, align: Align | None = None
) -> DataFrame:
    """Final outcome of every evaluated observation; ``evaluated`` is a stored table with a delivery number.

    Canonical rows are settled first (first non-rejected arrival of a new id), then
    compared in arrival order with earlier canonical rows of their source key. Both
    steps move only a few columns of the non-rejected rows. Their result is the list of
    exceptions, duplicates and out-of-order rows, which is joined back by delivery
    number: a broadcast while it is small, one balanced shuffle otherwise.
    """
    slim = evaluated.where(not_rejected()).select(
        "observation_id", *dict.fromkeys([*SOURCE_KEY, *TOTAL_ARRIVAL, "source_sequence", "observed_at"])
    )
    marked = mark_canonical(slim, canonical_prior, TOTAL_ARRIVAL, positions_prior, align)
    compared = compare_with_earlier(marked, positions_prior, TOTAL_ARRIVAL)
    exceptions = materialize(
        compared.where("out_of_order or not is_canonical").select(DELIVERY, "is_canonical", "out_of_order"), "exceptions"
    )
    joined = evaluated.join(exceptions, DELIVERY, "left").withColumns(
        {
            "is_canonical": F.coalesce("is_canonical", not_rejected()),
            "out_of_order": F.coalesce("out_of_order", F.lit(False)),
        }
    )
    duplicate = not_rejected() & ~F.col("is_canonical")
    return (
        raise_out_of_order(joined)
        .withColumn("outcome", F.when(duplicate, F.lit("DUPLICATE")).otherwise(F.col("outcome")))
        .select(*evaluated.columns, "is_canonical", "out_of_order")
        .drop(DELIVERY, ERROR)
    )


def with_receipts(batches: DataFrame, manifests: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Batches (``batch_id`` or ``batchId``) with receipt time and attempt count of their manifest.

    Joined before the observations are exploded, this moves one row for each batch. A
    batch without a manifest gets no receipt time. ``digests`` (batch_id, checksum) are computed anew from
    the stored bytes: with them ``digest_failed`` tells whether any object of the batch differs from the
    manifest's checksum, or none was found.
    """
    key = "batchId" if "batchId" in batches.columns else "batch_id"
    receipts = manifests.select(
        F.col("batch_id").alias("_receipt_id"), *[c for c in [*RECEIPT, *(["checksum"] if digests is not None else [])] if c in manifests.columns]
    )
    if digests is not None:
        computed = digests.groupBy(F.col("batch_id").alias("_receipt_id")).agg(
            F.min("checksum").alias("_least"), F.max("checksum").alias("_greatest")
        )
        same = (F.col("_least") == F.col("checksum")) & (F.col("_greatest") == F.col("checksum"))
        receipts = (
            receipts.join(computed, "_receipt_id", "left")
            .withColumn("digest_failed", ~F.coalesce(same, F.lit(False)))
            .drop("_least", "_greatest", "checksum")
        )
    return batches.drop(*RECEIPT, "digest_failed").join(receipts, batches[key] == F.col("_receipt_id"), "left").drop("_receipt_id")


def batch_error(columns: list[str]) -> Column:
    """Why a batch cannot be processed, seen at one of its rows; null if nothing is wrong with it.

    The checks run in order: stored bytes, then the document's contract version and number of observations,
    then its manifest and times. Those of ``CHECKED`` need their column. An unreadable document or an empty batch is a row
    without an item.
    """
    checked = {c: F.col(c) for c in CHECKED if c in columns}
    none = F.lit(False)
    limits = F.col("item_order").isNull()
    if "contract_version" in checked:
        limits = limits | ~checked["contract_version"].eqNullSafe(schemas.RAW_BATCH_CONTRACT)
    limits = limits | (checked.get("item_count", F.lit(0)) > schemas.MAX_OBSERVATIONS)
    return (
        F.when(F.coalesce(checked.get("digest_failed", none), none), F.lit("Raw object checksum verification failed"))
        .when(limits, F.lit("Stored raw batch violates the worker envelope limits"))
        .when(F.col("received_at").isNull(), F.concat(F.lit("Batch manifest is missing: "), F.coalesce("batch_id", F.lit(""))))
        .when(F.col("observed_at").isNull(), F.lit("Stored raw batch holds an observation without event time"))
    )


def process_batches(
    obs: DataFrame,
    mapping: MappingRules,
    quality: QualityRules,
    manifests: DataFrame | None = None,
    canonical_prior: History | None = None,
    positions_prior: DataFrame | None = None,
    processed_at: Column | None = None,
    replay_id: str | None = None,
    digests: DataFrame | None = None,
    align: Align | None = None,
) -> Processed:
    """One evaluation of ``obs``, written once, and its exceptions, read by the outputs.

    ``canonical_prior`` is the stored history (for known ids); ``positions_prior`` its
    compact per-source maxima, derived from it when not given. Running the same input
    against its own result adds no canonical row, and a batch that ``obs`` holds twice is
    stored once, its second copy being duplicates. A batch that cannot be processed has
    no outcome but a ``FAILED`` attempt with the reason; the others go on. ``digests`` of the stored
    objects are verified against ``manifests``. ``align`` deals new rows out like a history that is laid out by id.
    """
    if "raw_value" in obs.columns:
        obs = numeric_value(obs)
    if manifests is not None:
        obs = with_receipts(obs, manifests, digests)
    if processed_at is not None:
        obs = obs.withColumn("processed_at", processed_at)
    obs = obs.withColumn("source_sequence", F.coalesce("source_sequence", F.lit(0).cast("long")))
    evaluated = evaluate_observations(obs, mapping, quality).withColumns(
        {"replay_id": F.lit(replay_id).cast("string"), ERROR: batch_error(obs.columns), DELIVERY: F.monotonically_increasing_id()}
    ).drop(*CHECKED)
    # Three branches read the evaluation: decode, join and match rules only once.
    evaluated = materialize(evaluated, "evaluated")
    attempt = F.sha2(
        F.concat_ws("|", "batch_id", F.coalesce("replay_id", F.lit("live")), F.unix_micros("processed_at").cast("string")), 256
    )
    broken = materialize(failures_of(evaluated, attempt), "broken")
    if not broken.isEmpty():
        failed = broken.where("batch_id is not null").select("batch_id").distinct()
        evaluated = evaluated.where(F.col(ERROR).isNull()).join(failed, "batch_id", "left_anti")
    if positions_prior is None and canonical_prior is not None:
        canonical_prior = canonical_prior() if callable(canonical_prior) else canonical_prior
        positions_prior = materialize(source_positions(canonical_prior), "positions")
    decided = decide(evaluated, canonical_prior, positions_prior, align)
    canonical = canonical_of(decided)
    reached = source_positions(canonical)
    return Processed(
        canonical,
        merge_rejections(None, rejections_of(evaluated, attempt)),
        decided,
        attempts_of(decided, attempt).unionByName(broken),
        reached if positions_prior is None else merge_positions(positions_prior, reached),
    )


def canonical_of(decided: DataFrame) -> DataFrame:
    return (
        decided.where(F.col("outcome").isin("ACCEPTED", "FLAGGED"))
        .withColumn("raw_batch_id", F.col("batch_id"))
        .select(*schemas.CANONICAL_COLUMNS)
    )


def rejections_of(evaluated: DataFrame, attempt: Column) -> DataFrame:
    """Created at the processing instant; equal for every rejection of an attempt."""
    return evaluated.where(F.col("outcome") == "REJECTED").select(
        "observation_id", "batch_id", "replay_id", "source_tag", "reason_code", "reason", "mapping_version",
        "quality_rules_version", attempt.alias("processing_attempt_id"), F.col("processed_at").alias("created_at"),
    )


_ATTEMPT = ["batch_id", "replay_id", "mapping_version", "quality_rules_version"]


def attempts_of(decided: DataFrame, attempt: Column) -> DataFrame:
    by = [*_ATTEMPT, "processed_at"]
    counted = decided.select(*by, "outcome", attempt_number(decided), attempt.alias("processing_attempt_id"))
    return (
        batch_outcome_counts(counted, ("processing_attempt_id", "attempt_number", *by))
        .withColumn("status", F.lit("COMPLETED"))
        .withColumn("started_at", F.col("processed_at"))
        .withColumn("completed_at", F.col("processed_at"))
        .withColumn("last_error", F.lit(None).cast("string"))
        .drop("processed_at")
    )


def failures_of(evaluated: DataFrame, attempt: Column) -> DataFrame:
    """A failed attempt without counts for each batch with an error; documents without an id are told apart by path."""
    path = F.col("object_path") if "object_path" in evaluated.columns else F.lit(None).cast("string")
    told = F.when(F.col("batch_id").isNull(), F.concat_ws(": ", ERROR, path)).otherwise(F.col(ERROR))
    rows = evaluated.where(F.col(ERROR).isNotNull()).select(
        *_ATTEMPT, attempt_number(evaluated), attempt.alias("processing_attempt_id"), told.alias("_error"),
        F.coalesce("processed_at", F.current_timestamp()).alias("_at"),
        F.when(F.col("batch_id").isNull(), path).alias("_path"),
    )
    return empty_attempts(
        rows.groupBy(*_ATTEMPT, "_path").agg(
            *[F.min(c).alias(c) for c in ("attempt_number", "processing_attempt_id", "_error", "_at")]
        ),
        "FAILED", F.col("_at"), F.col("_error"),
    )


def empty_attempts(rows: DataFrame, status: str, at: Column, error: Column) -> DataFrame:
    """Attempts that counted nothing, in the form of ``attempts_of``."""
    return rows.select(
        "processing_attempt_id", F.col("attempt_number").cast("int").alias("attempt_number"), *_ATTEMPT,
        *[F.lit(0).cast("long").alias(c) for c in (*COUNTS, "total_count")],
        F.lit(status).alias("status"), at.alias("started_at"), at.alias("completed_at"), error.cast("string").alias("last_error"),
    )


def attempt_number(rows: DataFrame) -> Column:
    if "processing_attempt_count" in rows.columns:
        return (F.coalesce("processing_attempt_count", F.lit(0)) + 1).cast("int").alias("attempt_number")
    return F.lit(1).alias("attempt_number")
