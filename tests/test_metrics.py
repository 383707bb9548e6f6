from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0
from sensorloom.functions.quantile import bucket_quantile
from sensorloom.operators import aggregate, identity


def test_bucket_quantile(spark):
    rows = [(0, 0, 0), (10, 10, 10), (5, 10, 10), (0, 0, 4)]
    df = spark.createDataFrame(rows, "a int, b int, n int")
    q = bucket_quantile([1.0, 5.0], [F.col("a"), F.col("b")], F.col("n"), 0.9)
    got = [r[0] for r in df.select(q).collect()]
    assert got[0] is None and got[3] == 5.0
    assert abs(got[1] - 0.9) < 1e-12 and abs(got[2] - 4.2) < 1e-12


def attempt(n, status, at, error=None, accepted=0, replay=None):
    return (f"a{n}", "b", replay, status, T0 + timedelta(seconds=at), accepted, 0, 0, 0, error)


def fold(spark, attempts):
    manifest = spark.createDataFrame([("b", 4)], "batch_id string, observation_count long")
    table = spark.createDataFrame(
        attempts,
        "processing_attempt_id string, batch_id string, replay_id string, status string, completed_at timestamp, "
        "accepted_count long, flagged_count long, rejected_count long, duplicate_count long, last_error string",
    )
    r = aggregate.fold_batch_status(manifest, table).first()
    return r.processing_status, r.processing_attempt_count, r.accepted_count, r.last_error


def test_batch_status_fold(spark):
    assert fold(spark, [attempt(1, "FAILED", 1, "x")]) == ("RECEIVED", 1, 0, "x")
    assert fold(spark, [attempt(1, "FAILED", 1, "x"), attempt(2, "COMPLETED", 2, accepted=4), attempt(3, "COMPLETED", 3)]) == (
        "PROCESSED", 3, 4, None,
    )
    assert fold(spark, [attempt(1, "FAILED", 1, "x"), attempt(2, "TERMINAL", 2, "dead")]) == ("FAILED", 1, 0, "dead")
    assert fold(spark, [attempt(1, "COMPLETED", 1, accepted=4), attempt(2, "TERMINAL", 2, "dead")]) == ("PROCESSED", 1, 4, None)
    assert fold(spark, [attempt(1, "COMPLETED", 1, accepted=4, replay="r")]) == ("RECEIVED", 0, 0, None)


def test_receipts_against_stored_manifests(spark):
    rows = [("n", "x", T0, 1), ("n", "x", T0, 2), ("n", "y", T0, 3), ("s", "y", T0, 4), ("s", "x", T0, 5)]
    deliveries = spark.createDataFrame(rows, "batch_id string, checksum string, received_at timestamp, delivery_id long")
    stored = spark.createDataFrame([("s", "x")], "batch_id string, checksum string")
    got = identity.resolve_receipts(deliveries, stored).orderBy("delivery_id").collect()
    assert [r.receipt for r in got] == [
        "ACCEPTED", "ALREADY_ACCEPTED", "BATCH_CHECKSUM_CONFLICT", "BATCH_CHECKSUM_CONFLICT", "ALREADY_ACCEPTED",
    ]


def test_rollup_statuses(spark):
    counts = "accepted_count long, flagged_count long, rejected_count long, duplicate_count long"
    runs = spark.createDataFrame(
        [(r, s, 0, 0, 0, 0, 0) for r, s in (("done", "PENDING"), ("half", "PENDING"), ("new", "PENDING"), ("bad", "RUNNING"), ("old", "FAILED"), ("none", "COMPLETED"))],
        f"replay_id string, status string, processed_observation_count long, {counts}",
    )
    batches = spark.createDataFrame(
        [(r, s, 2, 2, 0, 0, 0) for r, s in (
            ("done", "COMPLETED"), ("half", "COMPLETED"), ("half", "PENDING"), ("new", "PENDING"), ("bad", "COMPLETED"), ("bad", "FAILED"), ("old", "COMPLETED"))],
        f"replay_id string, status string, processed_observation_count long, {counts}",
    )
    got = {r.replay_id: r.status for r in aggregate.rollup_replays(runs, batches).collect()}
    assert got == {"done": "COMPLETED", "half": "RUNNING", "new": "PENDING", "bad": "FAILED", "old": "FAILED", "none": "COMPLETED"}


def test_pending_gauges_when_nothing_waits(spark):
    df = spark.createDataFrame([(T0, True)], "ts timestamp, done boolean")
    row = aggregate.pending_gauges(df, ~F.col("done"), "ts", F.lit(T0), capacity=10).first()
    assert (row.pending, row.oldest_age_seconds, row.utilization_ratio) == (0, 0, 0.0)


def test_spikes_an_hour_apart_do_not_fire(spark):
    from sensorloom.operators.alerts import evaluate_alert

    minutes = [0, 60, 65, 70, 120]
    ratio = spark.createDataFrame([(T0 + timedelta(minutes=m), 0.5) for m in minutes], "window_start timestamp, ratio double")
    got = {r.window_start: r.state for r in evaluate_alert(ratio, "RejectionSpike").collect()}
    assert [got[T0 + timedelta(minutes=m)] for m in minutes] == ["pending", "pending", "firing", "firing", "pending"]


def test_new_attempts_fold_into_the_recorded_status(spark):
    manifest = spark.createDataFrame(
        [("b", "PROCESSED", 2, "old", 4, 0, 0, 0), ("c", "RECEIVED", 1, "old", 0, 0, 0, 0)],
        "batch_id string, processing_status string, processing_attempt_count long, last_error string, "
        "accepted_count long, flagged_count long, rejected_count long, duplicate_count long",
    )
    table = spark.createDataFrame(
        [attempt(1, "TERMINAL", 1, "dead")], "processing_attempt_id string, batch_id string, replay_id string, status string, "
        "completed_at timestamp, accepted_count long, flagged_count long, rejected_count long, duplicate_count long, last_error string",
    )
    got = {r.batch_id: (r.processing_status, r.processing_attempt_count, r.accepted_count, r.last_error) for r in aggregate.fold_batch_status(manifest, table).collect()}
    assert got == {"b": ("PROCESSED", 2, 4, "old"), "c": ("RECEIVED", 1, 0, "old")}
