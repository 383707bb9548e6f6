"""Integer vectors, and a stated set of queries met with all of them in blocks.

Candidates are cut into shards of a fixed number of values, queries into parts. A task is one shard
and one part: it gets the shard's rows first, then its queries one batch after another, so it holds
one shard and one batch of queries whatever the size of the tables. Rows are dealt by their number,
not by their content, so copies do not meet in one shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import BATCH_BYTES
from sensorloom.runtime import default_slices, materialize

SHARD_VALUES = 1 << 22
TASK_QUERIES = 1 << 14
LEAST_PART = 32
MOST_PARTITIONS = 100_000

#: Scores of vectors within this squared length fit in 64 bits.
LARGEST_SQUARE = float(1 << 58)


def integer_vectors(vectors: DataFrame, factor: int, *others: str) -> DataFrame:
    """(row, id, dim, v, *others), written once: floor(factor * x) of every component of the usable rows.

    ``row`` is a number of the row's own. Rows with a null vec_id, a null vector or a null or non-finite
    component are left out, and so are vectors whose integer form has a squared length above 2^58,
    whose scores have no 64-bit form.
    """
    x = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x"), *others).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    scaled = usable.withColumn("x", F.transform("x", lambda c: F.floor(c * float(factor))))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    kept = scaled.where(square <= LARGEST_SQUARE)
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), "id", F.size("x").alias("dim"), F.col("x").alias("v"), *others), "vectors")


def deal(
    candidates: DataFrame, queries: DataFrame, keys: list[str], shard_values: int = SHARD_VALUES, least_part: int = LEAST_PART
) -> DataFrame:
    """Every query of ``queries`` beside all ``candidates`` of its ``keys`` (``dim`` among them), as sorted tasks.

    A part has ``least_part`` queries or more, as each part gets the shard's rows anew. Adds ``shard``, ``part`` and ``kind`` (0 a candidate, 1 a query). A partition holds whole tasks in order.
    """
    spark = candidates.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    slices = default_slices(spark)
    n, q = F.col("n").cast("double"), F.col("q").cast("double")
    counted = materialize(
        candidates.groupBy(*keys).agg(F.count("*").alias("n"))
        .join(queries.groupBy(*keys).agg(F.count("*").alias("q")), keys)
        .withColumn("shards", F.ceil(n * F.greatest(F.col("dim"), F.lit(1)) / shard_values).cast("int")),
        "sizes",
    )
    work = counted.agg(F.sum(n * q)).first()[0] or 1.0
    wanted = F.greatest(F.ceil(q / TASK_QUERIES), F.ceil(n * q * slices / work / F.col("shards")))
    sizes = materialize(
        counted.withColumn("parts", F.least(wanted, F.greatest(F.ceil(q / least_part), F.ceil(q / TASK_QUERIES))).cast("int")).select(*keys, "shards", "parts"),
        "parts",
    )
    tasks = int(sizes.agg(F.sum(F.col("shards").cast("long") * F.col("parts"))).first()[0] or 1)
    dealt = (lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int"))
    every = (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    shard_rows = candidates.join(sizes, keys).select(
        *candidates.columns, dealt("shards").alias("shard"), every("parts").alias("part"), F.lit(0).alias("kind")
    )
    query_rows = queries.join(sizes, keys).select(
        *queries.columns, dealt("parts").alias("part"), every("shards").alias("shard"), F.lit(1).alias("kind")
    )
    by = [*keys, "shard", "part"]
    return (
        shard_rows.unionByName(query_rows, allowMissingColumns=True)
        .repartitionByRange(max(1, min(tasks, MOST_PARTITIONS)), *by)
        .sortWithinPartitions(*by, "kind", "row")
    )


def run_tasks(
    batches: Iterator[pa.RecordBatch], keys: list[str],
    build: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
) -> Iterator[pa.RecordBatch]:
    """Over the sorted rows of ``deal``: ``build`` once for the candidates of a task, ``answer`` for each run of its queries."""
    by = [*keys, "shard", "part", "kind"]
    at, held, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in by]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for low, high in zip([0, *change], [*change, batch.num_rows]):
            *task, kind = (c[low] for c in columns)
            if task != at:
                at, held, index = task, [], None
            rows = batch.slice(low, high - low)
            if kind == 0:
                held.append(rows)
            elif held or index is not None:  # else no candidate was dealt to this shard
                if index is None:
                    index, held = build(pa.Table.from_batches(held)), []
                yield from answer(index, rows)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """(rows, dim) integers of a list column whose lists all have ``dim`` values."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([matrix(c, dim) for c in column.chunks]) if column.num_chunks else np.zeros((0, dim), np.int64)
    return np.asarray(column.flatten()).reshape(len(column), dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores in order, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]
