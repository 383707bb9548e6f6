from __future__ import annotations

import random

from pyspark.sql import functions as F

from sensorloom.operators import scan
from sensorloom.operators.scan import Running, lookup_join, running, slice_rows


def test_running_equals_a_plain_loop_under_skew(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randint(0, 5)}", i, r.randint(0, 1000)) for i in range(3000)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, i int, v int")
    seeds = spark.createDataFrame([("hot", 990), ("k1", 5)], "k string, before int")
    got = running(
        slice_rows(df, ["k"], ["i"], slices=7),
        {
            "top": Running(F.col("v"), seed="before"),
            "top_here": Running(F.col("v"), inclusive=True),
            "position": Running(F.lit(1), kind="sum"),
            "total": Running(F.col("v"), kind="sum", inclusive=True),
        },
        seeds,
    )
    assert got.where("k = 'hot'").select(scan.SLICE).distinct().count() > 1
    seen, expected = {}, {}
    start = {"hot": 990, "k1": 5}
    for k, i, v in rows:
        before = seen.setdefault(k, [])
        tops = before + ([start[k]] if k in start else [])
        expected[i] = (max(tops) if tops else None, max(before + [v]), len(before), sum(before) + v)
        before.append(v)
    assert {r.i: (r.top, r.top_here, r.position, r.total) for r in got.collect()} == expected


def test_order_with_one_tied_first_column_is_still_sliced(spark):
    rows = [("a", 0, i, i % 17) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(5)
    got = running(slice_rows(df, ["k"], ["t", "i"], slices=8), {"top": Running(F.col("v"))})
    assert got.select(scan.SLICE).distinct().count() == 8
    top = None
    for r in sorted(got.collect(), key=lambda r: r.i):
        assert r.top == top
        top = max(top or 0, r.v)


def test_lookup_join(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "warm", "cold", "none", None]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int")
    lookup = spark.createDataFrame([(k, k.upper()) for k in ("hot", "warm", "cold", "other")], "k string, v string")
    got = lookup_join(df, lookup, ["k"], ["v"])
    assert got.columns == ["k", "i", "v"]
    expected = sorted((str(k), i, k.upper() if k in ("hot", "warm", "cold") else None) for k, i in rows)
    assert sorted((str(x.k), x.i, x.v) for x in got.collect()) == expected
