"""Runs that count as a whole or not at all, and histories laid out by what they are looked up by."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, T0, frame, identity, observation, random_rows, restated
from sensorloom.operators import identity as ids
from sensorloom.plans import job
from sensorloom.plans.process import process_batches
from sensorloom.rules import mapping_rules, quality_rules
from sensorloom.schemas import SOURCE_KEY
from sensorloom.sources import history
from sensorloom.sources.canonical import write_canonical
from sensorloom.sources.runs import ConflictingRun, RunStore

V0 = mapping_rules("controller-a-mapping-1.0.0")
QUALITY = quality_rules("quality-rules-1.0.0")


class Killed(RunStore):
    """Fails at the given write or at the success record."""

    def __init__(self, *args, at: str, **more):
        super().__init__(*args, **more)
        self.at = at

    def _hit(self, name):
        if name == self.at:
            raise InterruptedError(name)

    def write(self, run, name, *args):
        super().write(run, name, *args)
        self._hit(name)

    def write_ledger(self, run, name, *args):
        super().write_ledger(run, name, *args)
        self._hit(name)

    def record(self, run, *args):
        self._hit("record")
        super().record(run, *args)


def contents(store):
    samples = {(r.observation_id, tuple(r.flags), r.raw_batch_id) for r in job.canonical(store).collect()}
    rejected = {(r.observation_id, r.batch_id, r.reason_code) for r in job.rejections(store).collect()}
    tried = {(r.batch_id, r.accepted_count, r.flagged_count, r.rejected_count, r.duplicate_count) for r in job.attempts(store).collect()}
    assert job.canonical(store).count() == len(samples) == job.identities(store).count()
    assert job.rejections(store).count() == len(rejected)
    return samples, rejected, tried


@pytest.mark.parametrize("at", ["canonical", "record"])
def test_a_killed_run_leaves_nothing_that_counts(spark, tmp_path, at):
    rows = random_rows(5, 400)
    middle = T0 + timedelta(seconds=150)
    early, late = [r for r in rows if r["received_at"] < middle], [r for r in rows if r["received_at"] >= middle]
    at_once = RunStore(spark, str(tmp_path / "whole"), buckets=4)
    job.process_run(at_once, "all", frame(spark, rows), V0, QUALITY)
    expected, stored = restated(rows, V0, QUALITY)
    store = RunStore(spark, str(tmp_path / "runs"), buckets=4)
    assert job.process_run(store, "early", frame(spark, early), V0, QUALITY)
    before = contents(store)
    with pytest.raises(InterruptedError):
        job.process_run(Killed(spark, store.root, 4, at=at), "late", frame(spark, late), V0, QUALITY)
    assert contents(store) == before and not store.recorded("late")
    assert job.process_run(store, "late", frame(spark, late), V0, QUALITY)
    assert not job.process_run(store, "late", frame(spark, late), V0, QUALITY)
    assert not job.process_run(store, "early", frame(spark, early), V0, QUALITY)
    assert contents(store) == contents(at_once)
    assert job.canonical(store).count() == sum(e[0] in ("ACCEPTED", "FLAGGED") for e in expected.values())
    assert [r["run"] for r in store.records()] == ["early", "late"]


def test_a_run_over_batches_of_an_earlier_one_adds_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), buckets=4)
    obs = frame(spark, random_rows(6, 200))
    job.process_run(store, "one", obs, V0, QUALITY)
    samples, rejected, _ = contents(store)
    job.process_run(store, "two", obs, V0, QUALITY)
    assert contents(store)[:2] == (samples, rejected)
    assert store.records()[1]["rows"] == {"canonical": 0, "rejections": 0}


def test_another_session_reads_the_ledgers(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), buckets=4)
    job.process_run(store, "one", frame(spark, random_rows(7, 100)), V0, QUALITY)
    known = job.identities(store).count()
    store.close()
    assert job.identities(RunStore(spark, store.root, buckets=4)).count() == known > 0


def test_an_overtaken_run_is_refused(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), buckets=4)
    store.record("one", 0)
    with pytest.raises(ConflictingRun):
        store.record("two", 0)
    with pytest.raises(ConflictingRun):
        store.record("one", 1)
    assert not store.recorded("two")


def exchanges_below_ledger(df) -> list[str]:
    """Exchanges between the scan of a bucketed table and the join above it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    found = []
    for i, line in enumerate(lines):
        if "Bucketed: true" in line:
            at = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Join" in above:
                        break
                    if "Exchange" in above:
                        found.append(above.strip())
    assert any("Bucketed: true" in line for line in lines)
    return found


def test_the_history_side_of_a_join_is_not_shuffled(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), buckets=3)  # fewer than the shuffle partitions
    rows = random_rows(8, 200)
    job.process_run(store, "one", frame(spark, rows), V0, QUALITY)
    done = process_batches(frame(spark, rows), V0, QUALITY)
    accepted = done.outcomes.where("outcome <> 'REJECTED'")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history, audit = job.identities(store), store.read_ledger("audit", job.AUDIT, ids.REJECTION_KEY)
        joined = [
            ids.mark_known(ids.first_arrivals(accepted), history, store.aligned),
            ids.known_ids(ids.first_arrivals(accepted), history, align=store.aligned),
            ids.identity_conflicts(accepted, history, align=store.aligned),
            ids.merge_rejections(audit, done.rejections, store.aligned),
        ]
        for df in joined[:2] + joined[3:]:
            assert exchanges_below_ledger(df) == []
        assert joined[0].where("known").count() == joined[1].count() == job.canonical(store).count()
        assert joined[2].count() == ids.identity_conflicts(accepted, done.canonical).count()
        assert joined[3].count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_ledger_joins_find_conflicts_and_new_rejections(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), buckets=4)
    rows = [observation(), observation(item_order=1, source_sequence=2, raw_unit="K")]
    job.process_run(store, "one", frame(spark, rows), V0, QUALITY)
    moved = [
        observation(batch_id="b2", observed_at=T0 + timedelta(seconds=1)), observation(batch_id="b2", item_order=1, source_sequence=2, raw_unit="K"),
        observation(batch_id=rows[1]["batch_id"], item_order=1, source_sequence=2, raw_unit="K"),
    ]
    done = process_batches(frame(spark, moved), V0, QUALITY)
    conflicts = ids.identity_conflicts(done.outcomes.where("outcome <> 'REJECTED'"), job.identities(store), align=store.aligned).collect()
    assert [r.observation_id for r in conflicts] == [identity(rows[0])]
    new = ids.merge_rejections(store.read_ledger("audit", job.AUDIT, ids.REJECTION_KEY), done.rejections, store.aligned)
    assert [r.batch_id for r in new.collect()] == ["b2"]


def test_worker_checks_fail_their_batch_only(spark):
    rows = [observation(batch_id=f"batch-{i}", source_sequence=i) for i in range(6)]
    obs = frame(spark, rows).withColumn("contract_version", F.when(F.col("batch_id") == "batch-1", F.lit("raw-observation.batch.v9")).otherwise(
        F.when(F.col("batch_id") != "batch-2", F.lit("raw-observation.batch.v1"))))
    obs = obs.withColumn("item_count", F.when(F.col("batch_id") == "batch-3", F.lit(501)).otherwise(F.lit(500)))
    manifests = spark.createDataFrame([(f"batch-{i}", T0, f"sha256:{i}") for i in range(6)], "batch_id string, received_at timestamp, checksum string")
    digests = spark.createDataFrame(
        [("batch-0", "sha256:0"), ("batch-1", "sha256:1"), ("batch-2", "sha256:2"), ("batch-3", "sha256:3"), ("batch-4", "sha256:4"), ("batch-4", "sha256:other")],
        "batch_id string, checksum string",
    )
    done = process_batches(obs, V0, QUALITY, manifests=manifests, digests=digests)
    limits, bytes_ = "Stored raw batch violates the worker envelope limits", "Raw object checksum verification failed"
    assert {r.batch_id: r.last_error for r in done.attempts.collect()} == {
        "batch-0": None, "batch-1": limits, "batch-2": limits, "batch-3": limits, "batch-4": bytes_, "batch-5": bytes_,
    }
    assert [r.raw_batch_id for r in done.canonical.collect()] == ["batch-0"]


def test_only_days_of_the_looked_up_sequences_are_read(spark, tmp_path):
    rows = [observation(source_sequence=i, observed_at=T0 + timedelta(days=i // 10), received_at=T0 + timedelta(days=i // 10)) for i in range(60)]
    rows += [observation(source_sequence=100 + i, source_tag="CTRL_A.ZONE[04].RH_PV", raw_unit="%", observed_at=T0 + timedelta(days=i), received_at=T0 + timedelta(days=i)) for i in range(6)]
    done = process_batches(frame(spark, rows).withColumn("processed_at", F.col("received_at")), V0, QUALITY)
    write_canonical(done.canonical, str(tmp_path / "canonical"))
    stored = spark.read.parquet(str(tmp_path / "canonical"))
    index = history.merge_day_index(history.day_index(done.canonical), history.day_index(done.canonical))
    again = [observation(source_sequence=i) for i in (12, 15, 33, 999)] + [observation(source_sequence=101, source_tag="CTRL_A.ZONE[04].RH_PV", raw_unit="%")]
    firsts = ids.first_arrivals(process_batches(frame(spark, again), V0, QUALITY).outcomes, carry=(*SOURCE_KEY, "source_sequence"))
    found = ids.known_ids(firsts, stored, done.positions, index=index)
    assert found.count() == 4
    scanned = re.findall(r"PartitionFilters: \[([^]]*)]", found._jdf.queryExecution().executedPlan().toString())
    assert any("2024-05-02" in s and "2024-05-04" in s and "2024-05-01" not in s and "2024-05-05" not in s for s in map(days_in, scanned))
    page = history.read_after_cursor(stored, EPOCH, 54, limit=None, index=index)
    assert sorted(r.source_sequence for r in page.collect()) == [*range(55, 60), *range(100, 106)]
    nothing = history.read_after_cursor(stored, EPOCH, 5_000, limit=None, index=index)
    assert nothing.collect() == []


def days_in(filters: str) -> str:
    """Partition filters with day numbers spelled out."""
    return re.sub(r"\b(19\d{3})\b", lambda m: str(date(1970, 1, 1) + timedelta(days=int(m[1]))), filters)
