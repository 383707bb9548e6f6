from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import T0, frame, identity, observation, random_rows, restated
from sensorloom.operators import identity as ids
from sensorloom.operators.aggregate import outcome_balance
from sensorloom.operators.evaluate import evaluate_observations
from sensorloom.operators.order import source_positions
from sensorloom.plans.process import process_batches
from sensorloom.plans.replay import replay
from sensorloom.rules import ReplayRequest, mapping_rules, quality_rules

V0, V1 = mapping_rules("controller-a-mapping-1.0.0"), mapping_rules("controller-a-mapping-1.1.0")
QUALITY = quality_rules("quality-rules-1.0.0")


def outcomes(done):
    return {
        (r.batch_id, r.item_order): (r.outcome, r.reason_code, tuple(r.flags), r.out_of_order)
        for r in done.outcomes.collect()
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_row_by_row_processing(spark, seed):
    rows = random_rows(seed, 600)
    expected, _ = restated(rows, V0, QUALITY)
    assert {e[0] for e in expected.values()} == {"ACCEPTED", "FLAGGED", "REJECTED", "DUPLICATE"}
    assert outcomes(process_batches(frame(spark, rows).repartition(5), V0, QUALITY)) == expected


@pytest.mark.parametrize("with_positions", [False, True])
def test_history_is_carried_in(spark, with_positions):
    rows = random_rows(9, 800)
    middle = T0 + timedelta(seconds=300)
    old, new = [r for r in rows if r["received_at"] < middle], [r for r in rows if r["received_at"] >= middle]
    expected_old, stored = restated(old, V0, QUALITY)
    expected_new, _ = restated(new, V0, QUALITY, stored)
    first = process_batches(frame(spark, old), V0, QUALITY)
    assert outcomes(first) == expected_old
    positions = source_positions(first.canonical) if with_positions else None
    second = process_batches(frame(spark, new), V0, QUALITY, canonical_prior=first.canonical, positions_prior=positions)
    assert outcomes(second) == expected_new


def test_second_run_adds_nothing_and_balances(spark):
    obs = frame(spark, random_rows(4, 300))
    first = process_batches(obs, V0, QUALITY)
    again = process_batches(obs, V0, QUALITY, canonical_prior=first.canonical)
    assert again.canonical.count() == 0
    assert first.rejections.count() == again.rejections.count() > 0
    assert ids.merge_rejections(first.rejections, again.rejections).count() == 0
    assert ids.duplicate_identities(first.canonical).count() == 0
    counts = first.attempts.groupBy("batch_id").agg(
        F.sum("total_count").alias("observation_count"),
        *[F.sum(c).alias(c) for c in ("accepted_count", "flagged_count", "rejected_count", "duplicate_count")],
    ).withColumn("processing_status", F.lit("PROCESSED"))
    row = outcome_balance(counts).first()
    assert row.observations == row.outcomes == 300 and row.balanced


def test_same_id_on_two_days_is_one_identity_and_a_conflict(spark):
    rows = [observation(), observation(item_order=1, observed_at=T0 - timedelta(days=1)), observation(item_order=2)]
    done = process_batches(frame(spark, rows), V0, QUALITY)
    assert [r.outcome for r in done.outcomes.orderBy("item_order").collect()] == ["ACCEPTED", "DUPLICATE", "DUPLICATE"]
    accepted = evaluate_observations(frame(spark, rows), V0, QUALITY)
    (conflict,) = ids.identity_conflicts(accepted).collect()
    assert conflict.observation_id == identity(rows[0]) and conflict.arrivals == 1
    assert conflict.conflicting_observed_at == T0 - timedelta(days=1)


def test_rejected_rows_do_not_claim_an_id(spark):
    rows = [observation(raw_unit="bad"), observation(item_order=1)]
    done = process_batches(frame(spark, rows), V0, QUALITY)
    assert [r.outcome for r in done.outcomes.orderBy("item_order").collect()] == ["REJECTED", "ACCEPTED"]


def test_received_at_and_attempt_number_come_from_the_manifest(spark):
    manifest = spark.createDataFrame(
        [(observation()["batch_id"], T0 + timedelta(seconds=400), 2)],
        "batch_id string, received_at timestamp, processing_attempt_count int",
    )
    obs = frame(spark, [observation()]).drop("received_at", "processed_at")
    done = process_batches(obs, V0, QUALITY, manifests=manifest, processed_at=F.lit(T0 + timedelta(seconds=401)))
    (row,) = done.canonical.collect()
    assert row.flags == ["LATE_ARRIVAL"] and row.processed_at == T0 + timedelta(seconds=401)
    assert done.attempts.first().attempt_number == 3


def test_replay_recovers_tags_once(spark):
    rows = [
        observation(source_sequence=i, item_order=i, source_tag=f"CTRL_A.ZONE[01].{p}", observed_at=T0 + timedelta(minutes=i))
        for i, p in enumerate(["TEMP_PV", "TEMP_AUX_PV", "TEMP_AUX_PV", "TEMP_AUX_PV"])
    ]
    obs = frame(spark, rows)
    live = process_batches(obs, V0, QUALITY)
    assert live.canonical.count() == 1
    manifest = obs.groupBy("batch_id", "facility_id", "received_at").agg(
        F.min("observed_at").alias("minimum_observed_at"), F.max("observed_at").alias("maximum_observed_at")
    )
    request = ReplayRequest("r-1", "facility-alpha", T0, T0 + timedelta(minutes=3), V1.version, "recover", requested_at=T0)
    at = F.lit(T0 + timedelta(days=1))
    done = replay(request, manifest, obs, live.canonical, at)
    assert sorted(r.source_sequence for r in done.result.canonical.collect()) == [1, 2]
    run = done.runs.first()
    assert (run.status, run.processed_observation_count, run.accepted_count + run.flagged_count, run.duplicate_count) == ("COMPLETED", 3, 2, 1)
    again = replay(request, manifest, obs, live.canonical.unionByName(done.result.canonical), at)
    assert again.result.canonical.count() == 0 and again.runs.first().duplicate_count == 3


def test_replay_without_batches_is_completed(spark):
    obs = frame(spark, [observation()])
    live = process_batches(obs, V0, QUALITY)
    manifest = obs.groupBy("batch_id", "facility_id", "received_at").agg(
        F.min("observed_at").alias("minimum_observed_at"), F.max("observed_at").alias("maximum_observed_at")
    )
    request = ReplayRequest("r-2", "facility-alpha", T0 + timedelta(days=3), T0 + timedelta(days=4), V1.version, "none")
    done = replay(request, manifest, obs, live.canonical, F.lit(T0))
    assert (done.runs.first().status, done.runs.first().matching_batch_count) == ("COMPLETED", 0)


def test_scratch_tables_are_dropped_with_their_scope(spark, tmp_path):
    from pathlib import Path

    from sensorloom.runtime import scratch_scope

    with scratch_scope(spark) as folder:
        done = process_batches(frame(spark, random_rows(5, 50)), V0, QUALITY)
        done.canonical.write.parquet(str(tmp_path / "out"))
        assert len(list(Path(folder).iterdir())) >= 3
    assert not Path(folder).exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def settled(done):
    return sorted((r.batch_id, r.item_order, r.outcome) for r in done.outcomes.collect())


@pytest.mark.parametrize("seed", [6, 7])
def test_batches_read_twice_in_one_run(spark, seed):
    rows = random_rows(seed, 400)
    again = [r for r in rows if int(r["batch_id"][-4:]) % 3 == 0]
    expected, _ = restated(rows, V0, QUALITY)
    kinds = [(k[0], k[1], e[0]) for k, e in expected.items()]
    for r in again:
        key = (r["batch_id"], r["item_order"])
        kinds.append((*key, "REJECTED" if expected[key][0] == "REJECTED" else "DUPLICATE"))
    done = process_batches(frame(spark, rows + again).repartition(5), V0, QUALITY)
    assert settled(done) == sorted(kinds)
    assert ids.duplicate_identities(done.canonical).count() == 0
    key = ["observation_id", "batch_id", "reason_code"]
    assert done.rejections.groupBy(*key).count().where("count > 1").count() == 0
    later = process_batches(frame(spark, rows + again), V0, QUALITY, canonical_prior=done.canonical, positions_prior=done.positions)
    assert later.canonical.count() == 0 and later.outcomes.count() == len(rows) + len(again)


def test_a_batch_that_cannot_be_processed_fails_alone(spark):
    good, late, lost = (f"00000000-0000-4000-8000-00000000000{i}" for i in (1, 2, 3))
    rows = [
        observation(batch_id=good), observation(batch_id=good, item_order=1, source_sequence=None),
        observation(batch_id=late), observation(batch_id=late, item_order=1, observed_at=None),
        observation(batch_id=lost), observation(batch_id=None, item_order=None, source_sequence=None, observed_at=None),
    ]
    manifests = spark.createDataFrame([(good, T0, 4), (late, T0, 0)], "batch_id string, received_at timestamp, processing_attempt_count int")
    done = process_batches(frame(spark, rows), V0, QUALITY, manifests=manifests, processed_at=F.lit(T0))
    got = {r.batch_id: (r.status, r.attempt_number, r.total_count, r.last_error) for r in done.attempts.collect()}
    assert got[good] == ("COMPLETED", 5, 2, None)
    assert got[late][:3] == ("FAILED", 1, 0) and "event time" in got[late][3]
    assert got[lost][:3] == ("FAILED", 1, 0) and "manifest is missing" in got[lost][3]
    assert got[None][0] == "FAILED" and len(got) == 4
    assert {r.batch_id for r in done.outcomes.collect()} == {good}


def test_replay_of_a_missing_object_fails_the_run(spark):
    a, b, c = (f"00000000-0000-4000-8000-00000000000{i}" for i in (1, 2, 3))
    obs = frame(spark, [observation(batch_id=a), observation(batch_id=c, source_sequence=9, observed_at=T0 + timedelta(hours=2))])
    manifest = spark.createDataFrame(
        [(x, "facility-alpha", T0, T0, T0 + timedelta(hours=3), 1) for x in (a, b, c)],
        "batch_id string, facility_id string, received_at timestamp, minimum_observed_at timestamp, maximum_observed_at timestamp, processing_attempt_count int",
    )
    live = process_batches(obs, V0, QUALITY)
    request = ReplayRequest("r-3", "facility-alpha", T0, T0 + timedelta(hours=1), V1.version, "again", requested_at=T0)
    done = replay(request, manifest, obs, live.canonical, F.lit(T0 + timedelta(days=1)))
    got = {r.batch_id: (r.status, r.total_count, r.attempt_number) for r in done.result.attempts.collect()}
    assert got == {a: ("COMPLETED", 1, 2), b: ("FAILED", 0, 2), c: ("COMPLETED", 0, 2)}
    assert {r.batch_id: r.status for r in done.replay_batches.collect()} == {a: "COMPLETED", b: "FAILED", c: "COMPLETED"}
    assert done.runs.first().status == "FAILED"
