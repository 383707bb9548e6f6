"""Identity: first-wins deduplication, history, conflicts, receipts, idempotent audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.scan import lookup_join
from sensorloom.runtime import materialize
from sensorloom.schemas import ARRIVAL, DELIVERY, SOURCE_KEY, TOTAL_ARRIVAL
from sensorloom.sources.history import HIGH, LOW, days_with, on_days

# Stored canonical rows, or a function that opens them only if they are needed.
History = DataFrame | Callable[[], DataFrame]

# Deals rows out by keys like a history that is stored bucketed by them, so that a join leaves the history in place.
Align = Callable[[DataFrame, list[str]], DataFrame]


def _aligned(rows: DataFrame, keys: list[str], align: Align | None) -> DataFrame:
    return rows if align is None else align(rows, keys)


def not_rejected() -> Column:
    return F.col("outcome") != "REJECTED"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a unique delivery number, written once so that all readers agree on it."""
    if DELIVERY in rows.columns:
        return rows
    return materialize(rows.withColumn(DELIVERY, F.monotonically_increasing_id()), "numbered")


def first_arrivals(accepted: DataFrame, order: list[str] = ARRIVAL, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per observation id with the order of its first arrival and its copies.

    The minimum is combined before the shuffle, so a much re-delivered id costs one
    row per task. ``carry`` keeps more columns of the first arrival.
    """
    kept = [*order, *[c for c in carry if c not in order]]
    return (
        accepted.groupBy("observation_id")
        .agg(F.min(F.struct(*kept)).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select("observation_id", "copies", *[F.col(f"_first.{c}").alias(c) for c in kept])
    )


def mark_known(accepted: DataFrame, canonical: DataFrame, align: Align | None = None) -> DataFrame:
    """Add ``known``: the id is already stored. ``accepted`` should hold one row per id."""
    stored = canonical.select("observation_id", F.lit(True).alias("_stored"))
    return (
        _aligned(accepted, ["observation_id"], align).join(stored, "observation_id", "left")
        .withColumn("known", F.coalesce("_stored", F.lit(False)))
        .drop("_stored")
    )


def known_ids(
    firsts: DataFrame, canonical: History, positions: DataFrame | None = None, align: Align | None = None,
    index: DataFrame | None = None, day: str = "observed_date",
) -> DataFrame:
    """The ids of ``firsts`` (one row per id) that are stored already.

    An id contains its source key and sequence, so one beyond the highest stored
    sequence of its key is new for certain. With ``positions`` only the other ids are
    looked up, in the part of the history that their sequences span; usually there
    are none and the history is not read at all. With the day ``index`` of the history too, only
    days that hold sequences of that span of their source key are read, of the partition column ``day``.
    """
    if positions is None:
        canonical = canonical() if callable(canonical) else canonical
        wanted, stored = firsts.select("observation_id"), canonical.select("observation_id")
        if align is None:
            return wanted.join(stored, "observation_id", "left_semi")
        # a semi-join moves below what its left side does, so the dealing out stands on the right
        return stored.join(align(wanted, ["observation_id"]), "observation_id", "left_semi")
    placed = lookup_join(firsts, positions, SOURCE_KEY, ["max_sequence"])
    doubtful = materialize(
        placed.where("source_sequence <= max_sequence").select("observation_id", *SOURCE_KEY, "source_sequence"), "doubtful"
    )
    span = doubtful.agg(F.min("source_sequence").alias("low"), F.max("source_sequence").alias("high")).first()
    if span["low"] is None:
        return doubtful.select("observation_id")
    canonical = canonical() if callable(canonical) else canonical
    if index is not None:
        spans = doubtful.groupBy(*SOURCE_KEY).agg(F.min("source_sequence").alias(LOW), F.max("source_sequence").alias(HIGH))
        canonical = on_days(canonical, days_with(index, spans), day)
    history = canonical.where(F.col("source_sequence").between(span["low"], span["high"])).select("observation_id")
    wanted = _aligned(doubtful.select("observation_id"), ["observation_id"], align)
    return history.join(wanted, "observation_id", "left_semi")


def mark_canonical(
    accepted: DataFrame,
    canonical_prior: History | None = None,
    order: list[str] | None = None,
    positions_prior: DataFrame | None = None,
    align: Align | None = None,
) -> DataFrame:
    """Add ``is_canonical``: first non-rejected arrival of an id that is not stored yet.

    Exactly one row of an id wins, also if a batch was read twice; an ``order`` given
    must be total.

    Only contested ids, which arrived more than once or are stored, are joined back.
    While those are few the join is a broadcast and the rows are not shuffled.
    """
    columns = accepted.columns
    if order is None:
        accepted, order = numbered(accepted), TOTAL_ARRIVAL
    if canonical_prior is None:
        firsts = first_arrivals(accepted, order).withColumn("_known", F.lit(False))
    else:
        carried = first_arrivals(accepted, order, (*SOURCE_KEY, "source_sequence"))
        carried = materialize(carried, "firsts")
        stored = known_ids(carried, canonical_prior, positions_prior, align).withColumn("_stored", F.lit(True))
        firsts = carried.join(stored, "observation_id", "left").withColumn(
            "_known", F.coalesce("_stored", F.lit(False))
        )
    contested = firsts.where((F.col("copies") > 1) | F.col("_known")).select(
        "observation_id", "_known", F.struct(*order).alias("_first")
    )
    joined = lookup_join(accepted, contested, ["observation_id"], ["_known", "_first"])
    uncontested = F.col("_known").isNull()
    wins = ~F.col("_known") & F.struct(*order).eqNullSafe(F.col("_first"))
    return joined.withColumn("is_canonical", F.coalesce(uncontested | wins, F.lit(False))).select(
        *columns, "is_canonical"
    )


def dedup_first(
    evaluated: DataFrame, canonical_prior: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """Later arrivals of an id become ``DUPLICATE``; rejected rows never claim an id."""
    marked = mark_canonical(evaluated.where(not_rejected()), canonical_prior, order)
    settled = marked.withColumn(
        "outcome", F.when(F.col("is_canonical"), F.col("outcome")).otherwise(F.lit("DUPLICATE"))
    )
    rejected = evaluated.where(~not_rejected()).withColumn("is_canonical", F.lit(False))
    return settled.unionByName(rejected)


def identity_conflicts(
    accepted: DataFrame, canonical: DataFrame | None = None, order: list[str] = ARRIVAL, align: Align | None = None
) -> DataFrame:
    """Ids seen with another event time than the stored or first one.

    Arrivals are reduced to (id, event time) before the join. One row per conflicting
    event time with the number of arrivals.
    """
    pairs = accepted.groupBy("observation_id", "observed_at").agg(
        F.count(F.lit(1)).alias("arrivals"), F.min(F.struct(*order)).alias("_first")
    )
    holders = (
        pairs.groupBy("observation_id")
        .agg(
            F.min(F.struct(F.col("_first"), F.col("observed_at"))).alias("_holder"),
            F.count(F.lit(1)).alias("_copies"),
        )
        .select("observation_id", F.col("_holder.observed_at").alias("_holder_at"), "_copies")
    )
    if canonical is not None:
        stored = canonical.select("observation_id", F.col("observed_at").alias("_stored_at"))
        holders = _aligned(holders, ["observation_id"], align).join(stored, "observation_id", "left")
    else:
        holders = holders.withColumn("_stored_at", F.lit(None).cast("timestamp"))
    holders = holders.select("observation_id", "_copies", F.coalesce("_stored_at", "_holder_at").alias("stored_observed_at"))
    joined = lookup_join(pairs, holders, ["observation_id"], ["stored_observed_at"])
    return joined.where("observed_at <> stored_observed_at").select(
        "observation_id", "stored_observed_at", F.col("observed_at").alias("conflicting_observed_at"), "arrivals",
        F.lit("IDENTITY_CONFLICT").alias("reason_code"),
    )


def resolve_receipts(
    deliveries: DataFrame,
    manifests: DataFrame | None = None,
    order: list[str] | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Per batch id the first checksum wins.

    Adds ``receipt``: ``ACCEPTED`` for the first delivery of a new batch,
    ``ALREADY_ACCEPTED`` for the same checksum again, ``BATCH_CHECKSUM_CONFLICT`` for
    another one. ``order`` must be total within a batch id. ``stored`` (batch_id,
    object_key, checksum) are the objects of the store: one without a manifest, left by an
    acceptance that broke off, decides the checksum of its batch and is used again as
    ``reused_object_key``.
    """
    order = order or ["received_at", "delivery_id"]
    columns = deliveries.columns
    if stored is not None:
        orphans = stored if manifests is None else stored.join(manifests.select("batch_id"), "batch_id", "left_anti")
        orphans = orphans.groupBy("batch_id").agg(F.min(F.struct("object_key", "checksum")).alias("_o")).select(
            "batch_id", F.col("_o.checksum").alias("_orphan"), F.col("_o.object_key").alias("_orphan_key")
        )
        deliveries = lookup_join(deliveries, orphans, ["batch_id"], ["_orphan", "_orphan_key"])
    else:
        none = F.lit(None).cast("string")
        deliveries = deliveries.withColumns({"_orphan": none, "_orphan_key": none})
    may_win = F.col("_orphan").isNull() | (F.col("_orphan") == F.col("checksum"))
    firsts = deliveries.groupBy("batch_id").agg(
        F.min(F.when(may_win, F.struct(*order, "checksum"))).alias("_first"), F.max("_orphan").alias("_found")
    )
    if manifests is not None:
        recorded = manifests.select("batch_id", F.col("checksum").alias("_recorded"))
        firsts = firsts.join(recorded, "batch_id", "left")
    else:
        firsts = firsts.withColumn("_recorded", F.lit(None).cast("string"))
    firsts = firsts.select(
        "batch_id",
        F.coalesce("_recorded", "_found", F.col("_first.checksum")).alias("_winner"),
        F.when(F.col("_recorded").isNull() & F.col("_first").isNotNull(), F.struct(*[F.col(f"_first.{c}") for c in order])).alias("_opener"),
    )
    joined = lookup_join(deliveries, firsts, ["batch_id"], ["_winner", "_opener"])
    return joined.withColumn(
        "receipt",
        F.when(F.struct(*order).eqNullSafe(F.col("_opener")), F.lit("ACCEPTED"))
        .when(F.col("checksum") == F.col("_winner"), F.lit("ALREADY_ACCEPTED"))
        .otherwise(F.lit("BATCH_CHECKSUM_CONFLICT")),
    ).select(
        *columns, "receipt",
        *([] if stored is None else [F.when(F.col("receipt") == "ACCEPTED", F.col("_orphan_key")).alias("reused_object_key")]),
    )


# A rejection is recorded once per this key; a live run counts as one replay id.
NO_REPLAY = "00000000-0000-0000-0000-000000000000"
REJECTION_KEY = ["observation_id", "batch_id", "mapping_version", "quality_rules_version", "_replay", "reason_code"]


def rejection_keys(rejections: DataFrame) -> DataFrame:
    """The key of each rejection, as an audit laid out by it holds them."""
    return rejections.withColumn("_replay", F.coalesce("replay_id", F.lit(NO_REPLAY))).select(*REJECTION_KEY)


def merge_rejections(existing: DataFrame | None, new: DataFrame, align: Align | None = None) -> DataFrame:
    """The rejections of ``new`` that are not recorded yet, one per key, to be appended.

    ``existing`` holds rejections or the keys of ``rejection_keys``.
    """
    keyed = new.withColumn("_replay", F.coalesce("replay_id", F.lit(NO_REPLAY)))
    rest = [c for c in new.columns if c not in REJECTION_KEY]
    ranked = ["created_at", *[c for c in rest if c != "created_at"]]
    once = keyed.groupBy(*REJECTION_KEY).agg(F.min(F.struct(*ranked)).alias("_row"))
    if existing is not None:
        recorded = existing.select(*REJECTION_KEY) if "_replay" in existing.columns else rejection_keys(existing)
        if align is None:
            once = once.join(recorded, REJECTION_KEY, "left_anti")
        else:  # an anti-join would move below the new dealing out and undo it
            found = align(once, REJECTION_KEY).join(recorded.withColumn("_recorded", F.lit(True)), REJECTION_KEY, "left")
            once = found.where("_recorded is null").drop("_recorded")
    return once.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in new.columns])


def duplicate_identities(df: DataFrame, key: str = "observation_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_excess(df: DataFrame, key: str = "observation_id") -> DataFrame:
    """Rows beyond one per key, from counts per key so that no key set is gathered."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("excess_rows"),
    )
