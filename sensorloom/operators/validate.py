"""Batch and object validation: envelopes, items, sizes, digests, field limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.text import bad_identifier, bad_text, bad_uuid


def _bad_item(o: Column) -> Column:
    return (
        bad_identifier(o["sourceSystem"])
        | bad_uuid(o["sourceEpoch"])
        | F.coalesce(o["sourceSequence"] < 0, F.lit(False))
        | bad_text(o["sourceTag"], 256)
        | bad_text(o["rawUnit"], 32)
        | o["observedAt"].isNull()
        | o["rawValue"].isNull()
    )


def _has_bad_item() -> Column:
    return F.coalesce(F.exists("observations", _bad_item), F.lit(False))


def _envelope_reason(batches: DataFrame, maximum: int) -> Column:
    unreadable = F.col(schemas.CORRUPT).isNotNull() if schemas.CORRUPT in batches.columns else F.lit(False)
    size = F.coalesce(F.size("observations"), F.lit(0))
    invalid = F.lit("INVALID_ENVELOPE")
    return (
        F.when(unreadable, invalid)
        .when(~F.col("contractVersion").eqNullSafe(schemas.RAW_BATCH_CONTRACT), F.lit("UNSUPPORTED_CONTRACT_VERSION"))
        .when(bad_uuid(F.col("batchId")), invalid)
        .when(bad_identifier(F.col("collectorId")), invalid)
        .when(bad_text(F.col("collectorVersion"), 64), invalid)
        .when(bad_identifier(F.col("facilityId")), invalid)
        .when(F.col("createdAt").isNull(), invalid)
        .when((size < 1) | (size > maximum), F.lit("INVALID_OBSERVATION_COUNT"))
    )


def validate_batches(batches: DataFrame, maximum: int = schemas.MAX_OBSERVATIONS) -> DataFrame:
    """Add ``reason_code`` of the first failing envelope check, null when valid.

    A document that did not parse, or holds a field of the wrong type, is invalid first.
    """
    return batches.withColumn("reason_code", _envelope_reason(batches, maximum))


def validate_batch_items(batches: DataFrame) -> DataFrame:
    """Add ``reason_code``: one bad observation makes the whole batch invalid."""
    return batches.withColumn("reason_code", F.when(_has_bad_item(), F.lit("INVALID_ENVELOPE")))


def validate_contract(batches: DataFrame, maximum: int = schemas.MAX_OBSERVATIONS) -> DataFrame:
    """Envelope checks first, then the items."""
    reason = F.coalesce(_envelope_reason(batches, maximum), F.when(_has_bad_item(), F.lit("INVALID_ENVELOPE")))
    return batches.withColumn("reason_code", reason)


def check_object_sizes(
    objects: DataFrame,
    max_compressed: int = schemas.MAX_COMPRESSED_BYTES,
    max_decompressed: int = schemas.MAX_DECOMPRESSED_BYTES,
) -> DataFrame:
    """Add ``reason_code`` from ``length`` and ``decompressed_length`` (null if not measured).

    Batches packed into one file have no compressed length of their own: without that column
    only the other limit applies.
    """
    length = F.col("length") if "length" in objects.columns else F.lit(None).cast("long")
    return objects.withColumn(
        "reason_code",
        F.when(length > max_compressed, F.lit("COMPRESSED_PAYLOAD_TOO_LARGE")).when(
            F.col("decompressed_length") > max_decompressed, F.lit("PAYLOAD_TOO_LARGE")
        ),
    )


def verify_objects(digests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Recomputed against recorded checksum, one row per manifest with an object."""
    recorded = manifests.select("object_key", F.col("checksum").alias("recorded_checksum"))
    return digests.select("object_key", "checksum").join(recorded, "object_key").withColumn(
        "reason_code",
        F.when(F.col("checksum") != F.col("recorded_checksum"), F.lit("CHECKSUM_MISMATCH")),
    )


def field_limit_failure() -> Column:
    return (
        bad_text(F.col("source_system"), 64)
        | bad_text(F.col("source_epoch"), 64)
        | bad_text(F.col("source_tag"), 256)
        | bad_text(F.col("raw_unit"), 32)
    )


def check_field_limits(obs: DataFrame) -> DataFrame:
    return obs.withColumn("reason_code", F.when(field_limit_failure(), F.lit("FIELD_TOO_LONG")))
