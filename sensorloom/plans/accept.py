"""From delivered batches to receipts, stored objects and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.aggregate import build_manifests
from sensorloom.operators.identity import resolve_receipts
from sensorloom.operators.validate import validate_contract
from sensorloom.runtime import materialize


@dataclass(frozen=True)
class Accepted:
    receipts: DataFrame
    batches: DataFrame
    manifests: DataFrame


def accept_batches(
    deliveries: DataFrame, manifests: DataFrame | None = None, stored: DataFrame | None = None
) -> Accepted:
    """Validate deliveries and settle each batch id.

    ``deliveries`` are nested batches with ``delivery_id``, ``received_at``,
    ``object_key`` and ``checksum``. Every delivery gets a receipt: the code of the
    first failed check, or ``ACCEPTED``, ``ALREADY_ACCEPTED`` or
    ``BATCH_CHECKSUM_CONFLICT``. Only accepted ones become new ``batches`` (for the raw
    sink) and ``manifests``; a refused delivery never claims a batch id. With the objects
    of the store (``stored``) an accepted batch takes over one that was left without a
    manifest: its manifest names that object, and it is not among ``batches``.
    """
    checked = validate_contract(deliveries)
    slim = ["delivery_id", "batch_id", "received_at", "object_key", "checksum"]
    judged = materialize(
        checked.withColumn("batch_id", F.col("batchId")).select(*slim, "reason_code"), "judged"
    )
    settled = resolve_receipts(judged.where(F.col("reason_code").isNull()), manifests, stored=stored)
    refused = judged.where(F.col("reason_code").isNotNull()).withColumn("receipt", F.col("reason_code"))
    receipts = settled.unionByName(refused, allowMissingColumns=True).drop("reason_code")
    won = receipts.where(F.col("receipt") == "ACCEPTED")
    if stored is None:
        batches = deliveries.join(won.select("delivery_id"), "delivery_id", "left_semi")
        return Accepted(receipts, batches, build_manifests(batches))
    won = materialize(won.select("delivery_id", "reused_object_key"), "won")
    taken = deliveries.join(won, "delivery_id").withColumn("object_key", F.coalesce("reused_object_key", "object_key"))
    fresh = taken.where("reused_object_key is null").drop("reused_object_key")
    return Accepted(receipts, fresh, build_manifests(taken))
