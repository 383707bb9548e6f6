from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from helpers import T0, frame, random_rows
from sensorloom.operators import aggregate, fleet
from sensorloom.plans.process import process_batches
from sensorloom.rules import mapping_rules, quality_rules
from sensorloom.sources import raw
from sensorloom.streaming import absence, ingest, metrics, tiers

V0 = mapping_rules("controller-a-mapping-1.0.0")
QUALITY = quality_rules("quality-rules-1.0.0")
RESULT = ["batch_id", "item_order", "outcome", "reason_code", "flags", "out_of_order"]


def renumbered(rows):
    """Item order as the position inside each batch, and one receipt time per batch."""
    out, seen, receipt = [], {}, {}
    for r in rows:
        n = seen[r["batch_id"]] = seen.get(r["batch_id"], -1) + 1
        at = receipt.setdefault(r["batch_id"], r["received_at"])
        out.append(dict(r, item_order=n, received_at=at, processed_at=at + timedelta(seconds=1)))
    return out


def test_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    rows = renumbered(random_rows(21, 500))
    obs = frame(spark, rows)
    expected = sorted(map(str, process_batches(obs, V0, QUALITY).outcomes.select(*RESULT).collect()))
    flat = obs.withColumn("raw_value", F.parse_json(F.col("value").cast("string"))).withColumn("created_at", F.col("received_at"))
    documents = raw.assemble_batches(flat)
    manifests = obs.select("batch_id", "received_at").distinct()
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def run():
        ingest.stream_process(
            spark, landing, f"{out}/checkpoint", out, V0, QUALITY, lambda: manifests,
            F.timestamp_micros(F.unix_micros("received_at") + 1_000_000),
        ).awaitTermination()

    for low, high in ((0, 180), (180, 400), (400, 10_000)):
        age = F.unix_timestamp("received_at") - F.unix_timestamp(F.lit(T0))
        raw.write_raw_batches(documents.where((age >= low) & (age < high)), landing)
        run()
    run()  # nothing new
    got = spark.read.parquet(f"{out}/outcomes")
    assert got.select("micro_batch").distinct().count() == 3
    assert sorted(map(str, got.select(*RESULT).collect())) == expected
    stored = spark.read.parquet(f"{out}/canonical")
    assert stored.count() == stored.select("observation_id").distinct().count()


def test_order_state_equals_batch(spark, tmp_path):
    from sensorloom.operators.identity import mark_canonical, not_rejected
    from sensorloom.operators.evaluate import evaluate_observations
    from sensorloom.operators.order import flag_out_of_order

    rows = renumbered(random_rows(22, 400))
    marked = mark_canonical(evaluate_observations(frame(spark, rows), V0, QUALITY).where(not_rejected()))
    columns = ["batch_id", "item_order", "out_of_order", "flags"]
    expected = sorted(map(str, flag_out_of_order(marked).select(*columns).collect()))
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for part in (F.col("received_at") < T0 + timedelta(seconds=250), F.col("received_at") >= T0 + timedelta(seconds=250)):
        marked.where(part).write.mode("append").parquet(landing)
        ingest.stream_order_state(spark.readStream.schema(marked.schema).parquet(landing), f"{out}/c", out).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{out}/flagged").select(*columns).collect())) == expected


def test_rates_and_fleet(spark, tmp_path):
    outcomes = process_batches(frame(spark, random_rows(23, 300)), V0, QUALITY).outcomes.select("processed_at", "outcome")
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    # the later rows come first: nothing is dropped for being late
    for part in (F.col("processed_at") >= T0 + timedelta(seconds=250), F.col("processed_at") < T0 + timedelta(seconds=250)):
        outcomes.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(outcomes.schema).parquet(landing)
        metrics.start_rates(stream, f"{out}/c", f"{out}/rates", "1 minute").awaitTermination()
    expected = aggregate.outcome_rates(outcomes, "5 minutes", slide="1 minute")
    assert sorted(map(str, metrics.read_rates(spark, f"{out}/rates", "5 minutes", slide="1 minute").collect())) == sorted(map(str, expected.collect()))

    beats = spark.createDataFrame(
        [("a", T0, 1, True), ("a", T0 + timedelta(seconds=60), 2, False), ("b", T0 + timedelta(seconds=1), 3, True)],
        "collector_id string, received_at timestamp, spool_observation_count long, source_connected boolean",
    )
    assert metrics.read_fleet_status(spark, f"{out}/fleet") is None
    landing = str(tmp_path / "beats")
    for part in (F.col("spool_observation_count") != 2, F.col("spool_observation_count") == 2):
        beats.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(beats.schema).parquet(landing)
        metrics.stream_heartbeats(stream, f"{out}/fc", f"{out}/fleet").awaitTermination()
    status = metrics.read_fleet_status(spark, f"{out}/fleet")
    now = F.lit(T0 + timedelta(seconds=120))
    shown = {r.collector_id: r.current_status for r in fleet.collector_inventory(status, now).collect()}
    assert shown == {"a": "SOURCE_DISCONNECTED", "b": "OFFLINE"}


def test_fleet_gauges_without_collectors(spark):
    empty = spark.createDataFrame(
        [], "last_heartbeat timestamp, spool_observation_count long, oldest_unsent_observation_age_seconds long"
    )
    row = fleet.fleet_gauges(empty, F.lit(T0)).first()
    assert row.heartbeat_age_seconds == float("inf") and row.spool_observations == 0


def test_micro_batches_are_merged_in_tiers(spark, tmp_path):
    out = str(tmp_path / "tiers")
    combine = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    add = lambda number, n: tiers.add(spark.createDataFrame([("a", n), ("b", 1)], "k string, n long"), out, number, combine, fan=3)
    assert tiers.read(spark, out) is None
    total, opened = 0, []
    for number in range(14):
        if number % 5 == 4:
            add(number, 999)  # an attempt that is run again
        add(number, number)
        total += number
        assert {r.k: r.n for r in combine(tiers.read(spark, out)).collect()} == {"a": total, "b": number + 1}
        opened.append(len(tiers.live(spark, out)))
    assert max(opened) <= 6 and [t for _, t in tiers.live(spark, out)] == [2, 1, 0, 0]
    kept = {p.name for p in (tmp_path / "tiers").iterdir() if not p.name.startswith("_")}
    assert {f for f, _ in tiers.live(spark, out)} <= kept and len(kept) <= 10
    assert len(list((tmp_path / "tiers" / "_live").glob("[0-9]*.json"))) == tiers.KEPT


def _beats(spark, rows, path):
    frame_ = spark.createDataFrame(rows, "collector_id string, received_at timestamp, source_connected boolean")
    frame_.coalesce(1).write.mode("append").parquet(path)
    return frame_.schema


def _watch(spark, schema, landing, out, clock):
    stream = spark.readStream.schema(schema).parquet(landing)
    absence.stream_absence(stream, f"{out}/checkpoint", f"{out}/status", clock).awaitTermination()
    return {r.collector_id: (r.current_status, r.changed_at) for r in absence.read_status(spark, f"{out}/status").collect()}


def test_collector_goes_offline_without_a_row_of_its_own(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    schema = _beats(spark, [("a", at(0), True), ("b", at(5), False), ("b", at(3), True), (None, at(4), True), ("c", None, True)], landing)
    naive = lambda s: at(s).replace(tzinfo=None)
    assert _watch(spark, schema, landing, out, "event") == {"a": ("ONLINE", naive(0)), "b": ("SOURCE_DISCONNECTED", naive(5))}
    _beats(spark, [("d", at(92), True)], landing)
    assert _watch(spark, schema, landing, out, "event") == {
        "a": ("OFFLINE", naive(90)), "b": ("SOURCE_DISCONNECTED", naive(5)), "d": ("ONLINE", naive(92)),
    }
    _beats(spark, [("a", at(100), True), ("d", at(101), False)], landing)
    assert _watch(spark, schema, landing, out, "event") == {
        "a": ("ONLINE", naive(100)), "b": ("OFFLINE", naive(95)), "d": ("SOURCE_DISCONNECTED", naive(101)),
    }


def test_absence_by_the_processing_clock(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    schema = _beats(spark, [("old", now - timedelta(hours=1), True), ("new", now + timedelta(hours=1), True)], landing)
    stream = spark.readStream.schema(schema).parquet(landing)
    query = absence.stream_absence(stream, f"{out}/checkpoint", f"{out}/status", trigger={"processingTime": "1 second"})
    try:
        got, deadline = {}, time.monotonic() + 60
        while got.get("old") != "OFFLINE" and time.monotonic() < deadline and query.isActive:
            time.sleep(1)
            status = absence.read_status(spark, f"{out}/status")
            got = {} if status is None else {r.collector_id: r.current_status for r in status.collect()}
    finally:
        query.stop()
    assert got == {"old": "OFFLINE", "new": "ONLINE"}
