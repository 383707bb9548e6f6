from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from sensorloom.llm import passages
from sensorloom.runtime import materialize, scratch_root


def shuffle_files(spark) -> int:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table = materialize(rows, "rows")
    for _ in range(50):
        if (left := shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert left <= before
    assert table.agg(F.sum("n")).first()[0] == 1000


def test_passages_leave_only_the_tables_they_return_from(spark):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    text = " ".join(f"w{i}" for i in range(60))
    found = passages.repeated_passages(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    made = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert made == {"repeated_pieces", "equal_runs"}
    assert sorted((r.doc_id, r.n_words, r.n_removed_words) for r in found.collect()) == [(1, 60, 0), (2, 60, 60)]
