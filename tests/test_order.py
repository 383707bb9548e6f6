from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, T0
from sensorloom.operators import order, work

LEVEL = "collector_id string, ts timestamp, i int, rows long"


def levels(spark, values, collector="edge-1"):
    return [(collector, T0 + timedelta(seconds=i), i, v) for i, v in enumerate(values)]


def paused(spark, rows, **kw):
    df = spark.createDataFrame(rows, LEVEL)
    got = order.hysteresis(df, 100_000, slices=3, **kw)
    return [r.paused for r in got.orderBy("collector_id", "ts").collect()]


def test_watermarks(spark):
    assert paused(spark, levels(spark, [79_499, 80_000, 60_001, 60_000, 79_999, 60_000])) == [
        False, True, True, False, False, False,
    ]
    assert paused(spark, levels(spark, [99_750, 60_000]), high_percent=100) == [True, False]
    with pytest.raises(ValueError):
        order.hysteresis(spark.createDataFrame([], LEVEL), 100, high_percent=50, low_percent=60)


def test_watermarks_equal_a_loop(spark):
    r = random.Random(2)
    rows = []
    for c in ("a", "b"):
        rows += levels(spark, [r.randint(50_000, 90_000) for _ in range(400)], c)
    expected = []
    for c in ("a", "b"):
        state = False
        for _, _, _, v in [x for x in rows if x[0] == c]:
            if state and v > 60_000:
                expected.append(True)
                continue
            state = v >= 80_000 or v + 500 > 100_000
            expected.append(state)
    assert paused(spark, rows) == expected


def test_alerts_equal_a_loop(spark):
    r = random.Random(8)
    rows, ts = [], T0
    for i in range(500):
        ts += timedelta(seconds=r.randint(1, 30))
        rows.append(("s", ts, i, r.choice([0, 1, 1, 1, 1]) if i % 9 else None))
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, v int")
    got = order.alert_states(df, F.col("v") == 1, 60, keys=["k"], slices=5).orderBy("i").collect()
    since = None
    states = set()
    for row, g in zip(rows, got):
        since = (since or row[1]) if row[3] == 1 else None
        state = "inactive" if since is None else "firing" if row[1] - since >= timedelta(seconds=60) else "pending"
        states.add(state)
        assert (g.active_since, g.state) == (since, state)
    assert states == {"inactive", "pending", "firing"}


def test_cursor_gap_and_recovery(spark):
    retained = spark.createDataFrame([("c", EPOCH, s) for s in range(33, 73)], "source_system string, source_epoch string, source_sequence long")
    cursors = spark.createDataFrame(
        [("c", EPOCH, 1), ("d", EPOCH, 1), ("c", "other", 1)], "source_system string, source_epoch string, cursor_sequence long"
    )
    (gap,) = order.detect_cursor_gap(cursors, retained).collect()
    assert (gap.earliest_sequence, gap.latest_sequence, gap.cursor_sequence) == (33, 72, 1)
    for cursor, gaps in ((0, 0), (31, 1), (32, 0)):
        one = cursors.limit(1).withColumn("cursor_sequence", F.lit(cursor))
        assert order.detect_cursor_gap(one, retained).count() == gaps
    gaps = cursors.limit(1).withColumn("cursor_sequence", F.lit(42))
    chosen = spark.createDataFrame([("c", EPOCH, 99)], "source_system string, source_epoch string, recovered_sequence long")
    assert order.recover_gap(gaps, chosen.limit(0)).select("cursor_sequence", "gap_detected").first() == (42, True)
    assert order.recover_gap(gaps, chosen).select("cursor_sequence", "gap_detected").first() == (99, False)


def test_batches_of_500_and_the_age_rule(spark):
    rows = [(i, "a", T0 + timedelta(seconds=i // 500)) for i in range(1001)] + [(5000, "b", T0 - timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id long, collector_id string, persisted_at timestamp")
    got = order.assign_batches(df, F.lit(T0 + timedelta(seconds=7)), slices=3)
    sizes = {
        (r.collector_id, r.batch_ordinal): (r.n, r.ready, r.top)
        for r in got.groupBy("collector_id", "batch_ordinal", "ready").agg(F.count("*").alias("n"), F.max("item_order").alias("top")).collect()
    }
    assert sizes == {("a", 0): (500, True, 499), ("a", 1): (500, True, 499), ("a", 2): (1, False, 0), ("b", 0): (1, True, 0)}


def test_acknowledged_rows_expire(spark):
    spool = spark.createDataFrame(
        [(1, "a", T0, None), (2, "a", T0, T0), (3, "a", T0, T0 + timedelta(minutes=20))],
        "id long, collector_id string, persisted_at timestamp, acknowledged_at timestamp",
    )
    items = spark.createDataFrame([("b1", 1)], "batch_id string, observation_id long")
    assert work.unbatched(spool, items.limit(0)).count() == 1 and work.unbatched(spool, items).count() == 0
    acked = spark.createDataFrame([("b1", T0)], "batch_id string, acknowledged_at timestamp")
    done = work.acknowledge(spool, items, acked)
    assert done.where("acknowledged_at is null").count() == 0
    assert [r.id for r in work.prune(done, "acknowledged_at", F.lit(T0 + timedelta(minutes=1))).collect()] == [3]
