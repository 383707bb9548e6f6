"""Manifests, outcome counts, replay and batch roll-ups, windowed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.quantile import bucket_quantile
from sensorloom.functions.timing import age_seconds, lag_millis

COUNTS = ["accepted_count", "flagged_count", "rejected_count", "duplicate_count"]

# Upper bounds of the lag histogram and the freshness objective, in seconds.
LAG_BOUNDS = [1, 5, 10, 20, 30, 60, 120, 300]
FRESHNESS_SECONDS = 30


def build_manifests(batches: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Manifest of nested raw batches; ``digests`` adds object key and checksum per batch.

    Columns ``received_at``, ``object_key``, ``checksum`` and ``content_digest`` of the batches are kept.
    """
    times = F.transform("observations", lambda o: o["observedAt"])
    manifests = batches.select(
        F.col("batchId").alias("batch_id"),
        F.col("collectorId").alias("collector_id"),
        F.col("collectorVersion").alias("collector_version"),
        F.col("facilityId").alias("facility_id"),
        F.col("contractVersion").alias("contract_version"),
        F.array_min(times).alias("minimum_observed_at"),
        F.array_max(times).alias("maximum_observed_at"),
        F.size("observations").alias("observation_count"),
        F.lit("RECEIVED").alias("processing_status"),
        *[F.col(c) for c in ("received_at", "object_key", "checksum", "content_digest") if c in batches.columns],
    )
    return manifests if digests is None else manifests.join(digests, "batch_id", "left")


def batch_outcome_counts(outcomes: DataFrame, by: tuple[str, ...] = ("batch_id", "replay_id")) -> DataFrame:
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.groupBy(*by).agg(
        is_("ACCEPTED").alias("accepted_count"),
        is_("FLAGGED").alias("flagged_count"),
        is_("REJECTED").alias("rejected_count"),
        is_("DUPLICATE").alias("duplicate_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def out_of_order_counts(outcomes: DataFrame) -> DataFrame:
    """Rows found out of order, duplicates included, and the canonical ones that carry the flag."""
    return outcomes.agg(
        F.count_if("out_of_order").alias("out_of_order_arrivals"),
        F.count_if(F.array_contains("flags", "OUT_OF_ORDER")).alias("out_of_order_samples"),
    )


def rollup_replays(runs: DataFrame, replay_batches: DataFrame) -> DataFrame:
    """Counters and status of each replay from its batches; a failed run stays as it is.

    With the batches' ``last_error`` the run has the error of one that failed.
    """
    errors = "last_error" in replay_batches.columns
    sums = replay_batches.groupBy("replay_id").agg(
        F.sum("processed_observation_count").alias("_processed"),
        *[F.sum(c).alias(f"_{c}") for c in COUNTS],
        F.count_if(F.col("status") != "COMPLETED").alias("_remaining"),
        F.count_if(F.col("status") == "COMPLETED").alias("_completed"),
        F.count_if(F.col("status") == "FAILED").alias("_failed"),
        *([F.max(F.when(F.col("status") == "FAILED", F.col("last_error"))).alias("_error")] if errors else []),
    )
    frozen = (F.col("status") == "FAILED") | F.col("_remaining").isNull()
    keep = lambda new, old: F.when(frozen, F.col(old)).otherwise(F.coalesce(F.col(new), F.lit(0)))
    status = (
        F.when(frozen, F.col("status"))
        .when(F.col("_failed") > 0, F.lit("FAILED"))
        .when(F.col("_remaining") == 0, F.lit("COMPLETED"))
        .when(F.col("_completed") > 0, F.lit("RUNNING"))
        .otherwise(F.col("status"))
    )
    return runs.join(sums, "replay_id", "left").select(
        *[c for c in runs.columns if c not in ("status", "processed_observation_count", *COUNTS)],
        keep("_processed", "processed_observation_count").alias("processed_observation_count"),
        *[keep(f"_{c}", c).alias(c) for c in COUNTS],
        F.coalesce("_remaining", F.lit(0)).alias("remaining_batches"),
        status.alias("status"),
        *([F.col("_error").alias("last_error")] if errors else []),
    )


def fold_batch_status(manifests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold new live attempts into their manifest and what it records already.

    The first completed attempt fixes status and counts, later ones only raise the
    attempt number; a batch recorded as ``PROCESSED`` keeps both. A terminal failure sets
    ``FAILED`` and its error unless a completed attempt came first. ``last_error`` is the
    error of the latest other attempt, null after a completed one. ``attempts`` has status
    ``COMPLETED``, ``FAILED`` or ``TERMINAL``.
    """
    completed = F.col("status") == "COMPLETED"
    order = F.struct("completed_at", "processing_attempt_id")
    folded = (
        attempts.where(F.col("replay_id").isNull())
        .groupBy("batch_id")
        .agg(
            F.count_if(F.col("status") != "TERMINAL").alias("processing_attempt_count"),
            F.count_if(completed).alias("_completed"),
            F.count_if(F.col("status") == "TERMINAL").alias("_terminal"),
            F.min(F.when(completed, F.struct("completed_at", "processing_attempt_id", *COUNTS))).alias("_first"),
            F.max_by(F.struct("last_error"), order).alias("_last"),
            F.max_by(F.struct("last_error"), F.when(F.col("status") != "TERMINAL", order)).alias("_last_tried"),
        )
    )
    kinds = {"processing_status": "string", "processing_attempt_count": "long", "last_error": "string", **dict.fromkeys(COUNTS, "long")}
    known = {c: manifests[c] if c in manifests.columns else F.lit(None).cast(kind) for c, kind in kinds.items()}
    was_processed = F.coalesce(known["processing_status"] == "PROCESSED", F.lit(False))
    processed = was_processed | F.coalesce(F.col("_completed") > 0, F.lit(False))
    last = F.when(processed, F.col("_last_tried")).otherwise(F.col("_last"))
    return manifests.join(folded, "batch_id", "left").select(
        *[manifests[c] for c in manifests.columns if c not in kinds],
        F.when(processed, F.lit("PROCESSED"))
        .when(F.col("_terminal") > 0, F.lit("FAILED"))
        .otherwise(F.coalesce(known["processing_status"], F.lit("RECEIVED")))
        .alias("processing_status"),
        (F.coalesce(known["processing_attempt_count"], F.lit(0)) + F.coalesce(folded["processing_attempt_count"], F.lit(0))).alias(
            "processing_attempt_count"
        ),
        *[
            F.coalesce(F.when(was_processed, known[c]).otherwise(F.col(f"_first.{c}")), known[c], F.lit(0)).alias(c)
            for c in COUNTS
        ],
        F.when(last.isNotNull(), last["last_error"]).otherwise(known["last_error"]).alias("last_error"),
    )


def outcome_balance(manifests: DataFrame) -> DataFrame:
    """Observations of processed batches against the sum of their outcomes."""
    counted = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return (
        manifests.where(F.col("processing_status") == "PROCESSED")
        .agg(
            F.coalesce(F.sum("observation_count"), F.lit(0)).alias("observations"),
            F.coalesce(F.sum(counted), F.lit(0)).alias("outcomes"),
        )
        .withColumn("balanced", F.col("observations") == F.col("outcomes"))
    )


def outcome_rates(
    outcomes: DataFrame,
    window: str,
    by: tuple[str, ...] = ("outcome",),
    slide: str | None = None,
    ts: str = "processed_at",
) -> DataFrame:
    """Count and per-second rate per time window; sliding windows overlap.

    Rows are counted once, in panes as long as the slide; only panes enter several windows.
    """
    if slide:
        panes = outcomes.groupBy(F.window(ts, slide).alias("_p"), *by).agg(F.count(F.lit(1)).alias("_n"))
        panes = panes.withColumn("_at", F.col("_p.start")).drop("_p")
        counted = panes.groupBy(F.window("_at", window, slide).alias("_w"), *by).agg(F.sum("_n").alias("observations"))
    else:
        counted = outcomes.groupBy(F.window(ts, window).alias("_w"), *by).agg(F.count(F.lit(1)).alias("observations"))
    seconds = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / F.lit(1_000_000)
    return counted.select(
        F.col("_w.start").alias("window_start"), *by, "observations",
        (F.col("observations") / seconds).alias("per_second"),
    )


def rejection_ratio(
    outcomes: DataFrame, window: str, threshold: float = 0.05, ts: str = "processed_at"
) -> DataFrame:
    return (
        outcomes.groupBy(F.window(ts, window).alias("_w"))
        .agg(
            F.count_if(F.col("outcome") == "REJECTED").alias("rejected"),
            F.count(F.lit(1)).alias("observations"),
        )
        .select(
            F.col("_w.start").alias("window_start"), "rejected", "observations",
            (F.col("rejected") / F.greatest(F.col("observations").cast("double"), F.lit(1e-9))).alias("ratio"),
        )
        .withColumn("spike", F.col("ratio") > threshold)
    )


def lag_summary(samples: DataFrame, window: str, ts: str = "processed_at") -> DataFrame:
    """Freshness of good canonical rows that are not ahead of the clock.

    Mean, cumulative histogram, p99 from the histogram and the share within the
    objective. Sums are whole milliseconds, so the result does not depend on row order.
    """
    fresh = samples.where((F.col("quality") == "GOOD") & (F.col("observed_at") <= F.col("processed_at"))).withColumn(
        "_lag", lag_millis(F.col("processed_at"), F.col("observed_at"))
    )
    grouped = fresh.groupBy(F.window(ts, window).alias("_w")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("_lag").alias("_total"),
        *[F.count_if(F.col("_lag") <= b * 1000).alias(f"le_{b}") for b in LAG_BOUNDS],
    )
    p99 = bucket_quantile([float(b) for b in LAG_BOUNDS], [F.col(f"le_{b}") for b in LAG_BOUNDS], F.col("samples"), 0.99)
    return grouped.select(
        F.col("_w.start").alias("window_start"), "samples",
        (F.col("_total") / F.lit(1000) / F.col("samples")).alias("mean_seconds"),
        *[f"le_{b}" for b in LAG_BOUNDS],
        p99.alias("p99_seconds"),
        (F.col(f"le_{FRESHNESS_SECONDS}") / F.col("samples")).alias("share_within_objective"),
    )


def lag_percentiles(samples: DataFrame, window: str, percentiles: tuple[float, ...] = (0.5, 0.99), ts: str = "processed_at") -> DataFrame:
    """Exact percentiles of the same lags in seconds to the millisecond, from counts of distinct milliseconds per window."""
    fresh = samples.where((F.col("quality") == "GOOD") & (F.col("observed_at") <= F.col("processed_at"))).withColumn(
        "_lag", lag_millis(F.col("processed_at"), F.col("observed_at"))
    )
    counted = fresh.groupBy(F.window(ts, window).alias("_w"), "_lag").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("_w").agg(
        *[F.round(F.percentile("_lag", F.lit(q), F.col("_n")) / 1000, 3).alias(f"p{q * 100:g}_seconds") for q in percentiles]
    ).select(F.col("_w.start").alias("window_start"), *[f"p{q * 100:g}_seconds" for q in percentiles])


SKETCH_SIZE = 400


def rank_error(size: int = SKETCH_SIZE) -> float:
    """By how much the rank of a sketched quantile may miss, at 99 % confidence; the fit published for this sketch."""
    return 2.296 / size**0.9723


def lag_sketches(samples: DataFrame, pane: str, size: int = SKETCH_SIZE, ts: str = "processed_at") -> DataFrame:
    """(pane_start, samples, sketch): the lags of each pane in milliseconds, in a sketch of bounded size to be stored.

    Sketches of any panes merge into those of longer windows, so days of lags are never read again.
    """
    fresh = samples.where((F.col("quality") == "GOOD") & (F.col("observed_at") <= F.col("processed_at"))).withColumn(
        "_lag", lag_millis(F.col("processed_at"), F.col("observed_at"))
    )
    return fresh.groupBy(F.window(ts, pane).alias("_p")).agg(
        F.count(F.lit(1)).alias("samples"), F.kll_sketch_agg_bigint("_lag", size).alias("sketch")
    ).select(F.col("_p.start").alias("pane_start"), "samples", "sketch")


def sketched_percentiles(
    panes: DataFrame, window: str, slide: str | None = None, percentiles: tuple[float, ...] = (0.5, 0.99)
) -> DataFrame:
    """Percentiles in seconds of tumbling or sliding windows from stored panes; ranks are within ``rank_error``."""
    at = F.window("pane_start", window, slide) if slide else F.window("pane_start", window)
    merged = panes.groupBy(at.alias("_w")).agg(F.sum("samples").alias("samples"), F.kll_merge_agg_bigint("sketch").alias("_s"))
    return merged.select(
        F.col("_w.start").alias("window_start"), "samples",
        *[(F.kll_sketch_get_quantile_bigint("_s", F.lit(q)) / 1000).alias(f"p{q * 100:g}_seconds") for q in percentiles],
    )


def pending_gauges(df: DataFrame, pending: Column, ts: str, now: Column, capacity: int | None = None) -> DataFrame:
    """Count and oldest age of pending rows; ``capacity`` adds the utilisation ratio."""
    gauges = df.agg(
        F.count_if(pending).alias("pending"), F.min(F.when(pending, F.col(ts))).alias("_oldest")
    ).select("pending", age_seconds(now, F.col("_oldest")).alias("oldest_age_seconds"))
    if capacity is not None:
        gauges = gauges.withColumn("utilization_ratio", F.col("pending") / F.lit(capacity))
    return gauges


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), *columns)


def stage_stats(
    attempts: DataFrame,
    window: str,
    by: tuple[str, ...] = (),
    started: str = "started_at",
    completed: str = "completed_at",
    failure_alert: int = 3,
) -> DataFrame:
    """Mean duration, successes and failures per window; more than ``failure_alert`` failures alert."""
    took = F.unix_micros(completed) - F.unix_micros(started)
    seconds = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / F.lit(1_000_000)
    return (
        attempts.groupBy(F.window(completed, window).alias("_w"), *by)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.sum(took).alias("_micros"),
            F.count_if(F.col("status") == "COMPLETED").alias("successes"),
            F.count_if(F.col("status") != "COMPLETED").alias("failures"),
        )
        .select(
            F.col("_w.start").alias("window_start"), *by, "attempts", "successes", "failures",
            (F.col("_micros") / F.lit(1_000_000) / F.col("attempts")).alias("mean_seconds"),
            (F.col("successes") / seconds).alias("successes_per_second"),
            (F.col("failures") / seconds).alias("failures_per_second"),
            (F.col("failures") > failure_alert).alias("failing"),
        )
    )
