"""Gauge series, interval joins and the rule index against row-by-row restatements."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.text import literal_prefix
from sensorloom.operators import series, work

DAY = datetime(2024, 3, 1)
STEP = 300


def over(step=STEP, hours=3):
    return F.lit(DAY), F.lit(DAY + timedelta(hours=hours)), step


def instants():
    return [DAY + timedelta(seconds=s) for s in range(0, 3 * 3600, STEP)]


def spans(seed: int, n: int = 300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        opened = DAY + timedelta(milliseconds=rng.randrange(-3_600_000, 4 * 3_600_000))
        wait = rng.choice([0, 1, 300, rng.randrange(7200)])
        out.append((rng.choice("aab"), opened, rng.choice([None, opened + timedelta(seconds=wait)]) if rng.random() < 0.02 else opened + timedelta(seconds=wait)))
    return out + [("c", DAY, DAY), ("c", DAY + timedelta(hours=1), DAY), ("c", None, None), ("b", DAY, DAY + timedelta(seconds=STEP)), ("b", DAY - timedelta(days=9), DAY + timedelta(seconds=1))]


@pytest.mark.parametrize("keys", [["k"], []])
def test_pending_series(spark, keys):
    rows = spans(len(keys))
    table = spark.createDataFrame(rows, "k string, opened timestamp, closed timestamp")
    got = series.pending_series(table, "opened", "closed", *over(), keys, capacity=4, slices=5)
    expected = {}
    for key in (set("abc") if keys else {None}):
        mine = [r for r in rows if key in (None, r[0]) and r[1] is not None]
        for t in instants():
            there = [o for _, o, c in mine if o <= t and (c is None or c > t)]
            expected[key, t] = (len(there), int((t - min(there)).total_seconds()) if there else 0, len(there) / 4)
    found = {(r.k if keys else None, r.sampled_at): (r.pending, r.oldest_age_seconds, r.utilization_ratio) for r in got.collect()}
    assert found == expected


def test_age_and_level_series(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), DAY + timedelta(seconds=rng.randrange(-4000, 12_000)), i, rng.randrange(9)) for i in range(60)]
    rows += [("c", DAY + timedelta(hours=2), 99, 1), ("d", DAY + timedelta(days=2), 98, 1), ("a", rows[0][1], 97, 5)]
    table = spark.createDataFrame(rows, "k string, at timestamp, n int, level int")
    ages = series.age_series(table, "at", *over(), ["k"], slices=3)
    levels = series.level_series(table, "at", "level", *over(), ["k"], stale_seconds=900, tie_break=("n",), slices=3)
    expected_age, expected_level = {}, {}
    for key in "abcd":
        for t in instants():
            before = [(at, n, level) for k, at, n, level in rows if k == key and at <= t]
            expected_age[key, t] = int((t - max(before)[0]).total_seconds()) if before else None
            expected_level[key, t] = max(before)[2] if before and t - max(before)[0] <= timedelta(seconds=900) else None
    assert {(r.k, r.sampled_at): r.age_seconds for r in ages.collect()} == expected_age
    assert {(r.k, r.sampled_at): r.level for r in levels.collect()} == expected_level


def test_series_of_nothing(spark):
    none = spark.createDataFrame([], "k string, opened timestamp, closed timestamp")
    assert series.pending_series(none, "opened", "closed", *over(), ["k"]).collect() == []
    assert {r.pending for r in series.pending_series(none, "opened", "closed", *over()).collect()} == {0}
    assert series.age_series(none, "opened", *over(hours=0), ["k"]).collect() == []


def test_overlapping_intervals(spark):
    rng = random.Random(7)

    def span(longest):
        low = DAY + timedelta(seconds=rng.randrange(30 * 86_400))
        return low, low + timedelta(seconds=rng.randrange(longest))

    left = [(i, rng.choice("xy"), *span(rng.choice([10, 86_400, 40 * 86_400]))) for i in range(200)]
    left += [(900, "x", datetime(1970, 1, 1), datetime(2261, 1, 1)), (901, "x", DAY, None), (902, "x", DAY + timedelta(days=2), DAY), (903, None, DAY, DAY)]
    right = [(i, rng.choice("xy"), *span(rng.choice([600, 86_400, 5 * 86_400]))) for i in range(150)]
    right += [(800, "x", DAY, DAY), (801, "x", DAY + timedelta(days=1), DAY + timedelta(days=2)), (802, "x", None, DAY)]
    a = spark.createDataFrame(left, "l int, k string, low timestamp, high timestamp")
    b = spark.createDataFrame(right, "r int, k string, start timestamp, stop timestamp")
    got = work.overlapping_intervals(a, b, ["k"], ("low", "high"), ("start", "stop"))
    expected = sorted(
        (i, j) for i, k, low, high in left for j, m, start, stop in right
        if None not in (k, low, high, start, stop) and k == m and low <= high and start < stop and low < stop and high >= start
    )
    assert sorted((r.l, r.r) for r in got.collect()) == expected and len(expected) > 500


def test_candidates_of_the_interval_join_grow_with_its_results(spark):
    """10,000 short requests over one facility: what the join compares stays near what overlaps."""
    minute = 60_000_000
    base = int(DAY.timestamp() * 1_000_000)
    at = lambda micros: F.timestamp_micros(F.lit(base) + micros)
    manifests = spark.range(10_000).select(
        F.lit("f").alias("facility_id"), F.col("id").cast("string").alias("batch_id"), at(F.col("id") * 60 * minute).alias("minimum_observed_at"),
        at(F.col("id") * 60 * minute + minute).alias("maximum_observed_at"),
    )
    requests = spark.range(10_000).select(
        F.col("id").cast("string").alias("replay_id"), F.lit("f").alias("facility_id"), at(F.col("id") * 60 * minute).alias("from_time"), at((F.col("id") + 1) * 60 * minute).alias("to_time"),
    )
    assert work.overlapping_batches(manifests, requests).count() == 10_000
    bins = work._bin(F.unix_micros("minimum_observed_at"), F.lit(0))
    candidates = manifests.groupBy(bins).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert candidates < 30 * 10_000  # against 100,000,000 pairs of the facility


@pytest.mark.parametrize(("pattern", "prefix"), [
    (r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.T", "CTRL_A.ZONE["), ("abc", "abc"), ("abc*", "ab"), ("abc?d", "ab"), ("abc{2}", "ab"), ("abc+", "abc"), ("a|b", ""),
    ("(?i)abc", ""), (r"ab\d", "ab"), (r"a\Qb\E", "a"), ("", ""), (r"\.\[", ".["), (r"a\.*", "a"), ("^a", ""), ("a.b", "a"),
])
def test_literal_prefix(pattern, prefix):
    assert literal_prefix(pattern) == prefix


def test_dense_short_spans_compare_little_more_than_overlaps(spark):
    """Ten-minute requests and batches of a few minutes, thousands a day: bins follow the spans, not the day."""
    at = lambda seconds: F.timestamp_micros(F.lit(int(DAY.timestamp() * 1_000_000)) + (seconds * 1_000_000).cast("long"))
    start = F.col("id") * 86_400 / 3000
    batches = spark.range(3000).select(F.lit("f").alias("k"), F.col("id").alias("l"), at(start).alias("low"), at(start + F.col("id") % 5 * 100).alias("high"))
    requests = spark.range(3000).select(F.lit("f").alias("k"), F.col("id").alias("r"), at(start - 300).alias("start"), at(start + 300).alias("stop"))
    spans = ["k"], ("low", "high"), ("start", "stop")
    kept = work.overlapping_intervals(batches, requests, *spans).count()
    on = (batches.k == requests.k) & (F.col("low") < F.col("stop")) & (F.col("high") >= F.col("start"))
    assert kept == batches.join(requests, on).count() > 50_000
    assert work._sharing_bins(batches, requests, *spans).count() < 5 * kept


def test_long_requests_take_few_bins(spark):
    """A request of a century among short batches lies in a few bins of each level that batches are on."""
    a = spark.createDataFrame([(i, "x", DAY + timedelta(days=i), DAY + timedelta(days=i, seconds=30)) for i in range(50)], "l int, k string, low timestamp, high timestamp")
    b = spark.createDataFrame([(1, "x", datetime(1970, 1, 1), datetime(2261, 1, 1))], "r int, k string, start timestamp, stop timestamp")
    spans = ["k"], ("low", "high"), ("start", "stop")
    assert work.overlapping_intervals(a, b, *spans).count() == 50 == work._sharing_bins(a, b, *spans).count()


def test_short_spans_are_dealt_to_one_bin(spark):
    """Requests of ten minutes around batches of a few minutes, some of an hour: a request is not copied for each level that batches are on."""
    at = lambda seconds: F.timestamp_micros(F.lit(int(DAY.timestamp() * 1_000_000)) + (seconds * 1_000_000).cast("long"))
    n = F.col("id")
    long = F.when(n % 50 == 0, 3600).when(n % 50 == 1, 900).otherwise(n % 5 * 20)
    batches = spark.range(1000).select(F.lit("f").alias("k"), n.alias("l"), at(n * 400).alias("low"), at(n * 400 + long).alias("high"))
    requests = spark.range(4000).select(F.lit("f").alias("k"), n.alias("r"), at(n * 100 - 300).alias("start"), at(n * 100 + 300).alias("stop"))
    spans = ["k"], ("low", "high"), ("start", "stop")
    moved = sum(row.n for side in work._binned(batches, requests, *spans) for row in [side.agg(F.count("*").alias("n")).first()])
    assert moved < 4000 + 3 * 1000
    pairs = [(i, j) for i in range(1000) for j in range(max(0, 4 * i - 3), 4000) if j * 100 - 300 <= i * 400 + (3600 if i % 50 == 0 else 900 if i % 50 == 1 else i % 5 * 20)
             and j * 100 + 300 > i * 400]
    assert sorted((r.l, r.r) for r in work.overlapping_intervals(batches, requests, *spans).collect()) == pairs


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_spans_share_one_bin_at_most(spark, seed):
    """Spans from points to years on both sides, whichever side lies in one bin and whichever levels are joined or spread."""
    rng = random.Random(seed)

    def side(n):
        longest = [rng.choice([1, 50, 4000, 10**6, 10**8]) for _ in range(3)]
        low = [DAY + timedelta(seconds=rng.randrange(-(10**rng.choice([3, 5, 7])), 10**6)) for _ in range(n)]
        return [(i, x, x + timedelta(seconds=rng.randrange(rng.choice(longest)))) for i, x in enumerate(low)]

    left, right = side(rng.choice([20, 300])), side(rng.choice([20, 300]))
    a, b = (spark.createDataFrame([("x", *r) for r in rows], f"k string, {c} int, {c}low timestamp, {c}high timestamp") for rows, c in ((left, "l"), (right, "r")))
    spans = ["k"], ("llow", "lhigh"), ("rlow", "rhigh")
    expected = sorted((i, j) for i, low, high in left for j, start, stop in right if start < stop and low < stop and high >= start)
    assert sorted((r.l, r.r) for r in work.overlapping_intervals(a, b, *spans).collect()) == expected
    compared = [(r.l, r.r) for r in work._sharing_bins(a, b, *spans).collect()]
    assert len(compared) == len(set(compared))
