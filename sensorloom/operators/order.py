"""Ordered scans: out-of-order flags, backpressure, source gaps, alerts, batch assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.identity import numbered
from sensorloom.operators.scan import Running, Sliced, continue_scan, running, slice_rows
from sensorloom.runtime import materialize
from sensorloom.schemas import ARRIVAL, DELIVERY, SOURCE_KEY, TOTAL_ARRIVAL


def source_positions(canonical: DataFrame) -> DataFrame:
    """Highest stored sequence and event time per source key: all that ordering needs of history."""
    return canonical.groupBy(*SOURCE_KEY).agg(
        F.max("source_sequence").alias("max_sequence"), F.max("observed_at").alias("max_observed_at")
    )


def merge_positions(*positions: DataFrame) -> DataFrame:
    merged = positions[0]
    for p in positions[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(*SOURCE_KEY).agg(
        F.max("max_sequence").alias("max_sequence"), F.max("max_observed_at").alias("max_observed_at")
    )


def compare_with_earlier(
    marked: DataFrame,
    positions_prior: DataFrame | None = None,
    order: list[str] = ARRIVAL,
    slices: int | None = None,
) -> DataFrame:
    """Arrival order, ``is_canonical`` and ``out_of_order`` of each non-rejected row.

    A row is out of order when its sequence or event time is below the maximum of
    earlier canonical rows of its source key. Only the columns this needs are
    shuffled; needs ``is_canonical``.
    """
    needed = dict.fromkeys([*SOURCE_KEY, *order, "source_sequence", "observed_at", "is_canonical"])
    sliced = slice_rows(marked.select(*needed), SOURCE_KEY, order, slices)
    scanned = running(
        sliced,
        {
            "_seen_sequence": Running(
                F.when(F.col("is_canonical"), F.col("source_sequence")), seed="max_sequence"
            ),
            "_seen_at": Running(F.when(F.col("is_canonical"), F.col("observed_at")), seed="max_observed_at"),
        },
        positions_prior,
    )
    behind = (F.col("source_sequence") < F.col("_seen_sequence")) | (F.col("observed_at") < F.col("_seen_at"))
    return scanned.select(*order, "is_canonical", F.coalesce(behind, F.lit(False)).alias("out_of_order"))


def raise_out_of_order(rows: DataFrame) -> DataFrame:
    """Canonical rows that are out of order get the flag and become ``FLAGGED``."""
    raised = F.col("out_of_order") & F.col("is_canonical")
    return rows.withColumn(
        "flags", F.when(raised, F.concat("flags", F.array(F.lit("OUT_OF_ORDER")))).otherwise(F.col("flags"))
    ).withColumn("outcome", F.when(raised, F.lit("FLAGGED")).otherwise(F.col("outcome")))


def flag_out_of_order(
    accepted: DataFrame,
    positions_prior: DataFrame | None = None,
    order: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out_of_order`` to each non-rejected row and flag the canonical ones.

    Duplicates are compared too but keep their outcome. Only out-of-order rows are
    joined back, by their delivery number; an ``order`` given must be total.
    """
    rows, key = accepted, order
    if order is None:
        rows, order, key = numbered(accepted), TOTAL_ARRIVAL, [DELIVERY]
    compared = compare_with_earlier(rows, positions_prior, order, slices)
    behind = materialize(compared.where("out_of_order").select(*key, "out_of_order"), "behind")
    joined = rows.join(behind, key, "left").withColumn("out_of_order", F.coalesce("out_of_order", F.lit(False)))
    return raise_out_of_order(joined).select(*accepted.columns, "out_of_order")


def hysteresis(
    series: DataFrame,
    max_rows: int,
    high_percent: int = 80,
    low_percent: int = 60,
    next_page: int = 500,
    keys: list[str] = ["collector_id"],
    order: list[str] = ["ts"],
    level: str = "rows",
    slices: int | None = None,
) -> DataFrame:
    """Add ``paused``: set at the high mark or when the next page would not fit, until the low mark."""
    if max_rows < 1 or low_percent < 0 or high_percent > 100 or low_percent >= high_percent:
        raise ValueError("spool watermarks are invalid")
    high = int(max_rows * (high_percent / 100.0) + 0.5)
    low = int(max_rows * (low_percent / 100.0) + 0.5)
    rows = F.col(level)
    event = F.when((rows >= high) | (rows + next_page > max_rows), F.lit(True)).when(rows <= low, F.lit(False))
    stamped = series.withColumn("_event", event)
    sliced = slice_rows(stamped, keys, order, slices)
    latest = F.when(F.col("_event").isNotNull(), F.struct(*order, "_event"))
    scanned = running(sliced, {"_latest": Running(latest, inclusive=True)})
    return scanned.withColumn("paused", F.coalesce(F.col("_latest._event"), F.lit(False))).select(
        *series.columns, "paused"
    )


def detect_cursor_gap(cursors: DataFrame, retained: DataFrame) -> DataFrame:
    """Cursors that fell behind the earliest retained reading of their epoch."""
    span = retained.groupBy("source_system", "source_epoch").agg(
        F.min("source_sequence").alias("earliest_sequence"), F.max("source_sequence").alias("latest_sequence")
    )
    return cursors.join(span, ["source_system", "source_epoch"]).where(
        (F.col("cursor_sequence") > 0) & (F.col("cursor_sequence") < F.col("earliest_sequence") - 1)
    )


def recover_gap(gaps: DataFrame, sequences: DataFrame) -> DataFrame:
    """Explicit recovery: a gap alone never moves a cursor, a recovery row sets it."""
    chosen = sequences.select("source_system", "source_epoch", F.col("recovered_sequence").alias("_to"))
    return (
        gaps.join(chosen, ["source_system", "source_epoch"], "left")
        .withColumn("cursor_sequence", F.coalesce("_to", "cursor_sequence"))
        .withColumn("gap_detected", F.col("_to").isNull())
        .drop("_to")
    )


def alert_states(
    metric: DataFrame,
    predicate: Column,
    for_seconds: int,
    keys: list[str] = [],
    order: list[str] = ["ts"],
    slices: int | None = None,
    step_seconds: int | None = None,
) -> DataFrame:
    """Add ``active_since`` and ``state`` (inactive, pending, firing).

    A condition fires once it has held at every sample for ``for_seconds``. The first
    column of ``order`` is the sample time. Samples are due every ``step_seconds``: a
    longer gap is a time without the condition, as in windows that counted nothing.
    """
    series = keys or ["_series"]
    ts = order[0]
    stamped = metric.withColumn("_on", F.coalesce(predicate, F.lit(False)))
    if not keys:
        stamped = stamped.withColumn("_series", F.lit(0))
    sliced = slice_rows(stamped, series, order, slices)
    previous = running(sliced, {"_previous": Running(F.struct(*order, "_on"))})
    went_on = F.coalesce(F.col("_previous._on"), F.lit(False))
    if step_seconds is not None:
        apart = F.unix_micros(ts) - F.unix_micros(F.col(f"_previous.{ts}"))
        went_on = went_on & (apart <= step_seconds * 1_000_000)
    starts = F.when(F.col("_on") & ~went_on, F.col(ts))
    marked = previous.withColumn("_start", starts).drop("_previous")
    scanned = running(continue_scan(sliced, marked), {"_since": Running(F.col("_start"), inclusive=True)})
    since = F.when(F.col("_on"), F.col("_since"))
    held = F.unix_micros(ts) - F.unix_micros("active_since")
    return (
        scanned.withColumn("active_since", since)
        .withColumn(
            "state",
            F.when(F.col("active_since").isNull(), F.lit("inactive"))
            .when(held >= for_seconds * 1_000_000, F.lit("firing"))
            .otherwise(F.lit("pending")),
        )
        .select(*metric.columns, "active_since", "state")
    )


def assign_batches(
    spool: DataFrame,
    now: Column,
    size: int = 500,
    max_age_seconds: int = 5,
    slices: int | None = None,
) -> DataFrame:
    """Cut each collector's unbatched rows into batches in id order.

    Adds ``batch_ordinal``, ``item_order`` and ``ready``: the batch is full, or its
    first row is older than ``max_age_seconds``. Rows of a batch are at most ``size``.
    """
    sliced: Sliced = slice_rows(spool, ["collector_id"], ["id"], slices)
    numbered = running(sliced, {"_before": Running(F.lit(1), kind="sum")})
    batch = Window.partitionBy("collector_id", "batch_ordinal")
    first_at = F.first("persisted_at").over(batch.orderBy("id"))
    count = F.count(F.lit(1)).over(batch)
    old = F.unix_micros(first_at) + max_age_seconds * 1_000_000 < F.unix_micros(now)
    return (
        numbered.withColumn("batch_ordinal", F.floor(F.col("_before") / size).cast("long"))
        .withColumn("item_order", (F.col("_before") % size).cast("int"))
        .withColumn("ready", (count >= size) | old)
        .select(*spool.columns, "batch_ordinal", "item_order", "ready")
    )
