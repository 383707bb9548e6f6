"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its ``depth`` nearest reference points (pivots) in order. Inverted
lists hold the vectors of each pivot; two vectors of a list are candidates if they share at least
``shared`` of their nearest pivots, and candidates are verified by exact cosine. A pair is handled
in the list of its first common pivot only. Long lists are split into blocks whose pairs of blocks
are groups of their own, so no task holds a hot list. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.components import connected_components, forest
from sensorloom.llm.tables import fraction_of
from sensorloom.runtime import materialize

THRESHOLD = 0.9
DEPTH = 8
SHARED = 2
LEAST_PIVOTS, MOST_PIVOTS = 16, 4096
BLOCK = 1024
PAIRS_AT_ONCE = 200_000


def pivot_count(n: int) -> int:
    """Reference points for ``n`` vectors: twice the square root, so lists grow as slowly as the pivots."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * n**0.5)))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """(rows, depth) pivot numbers by falling cosine, ties by number."""
    depth = min(depth, len(pivots))
    near = x @ pivots.T
    top = np.sort(np.argpartition(-near, depth - 1, axis=1)[:, :depth], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; by their largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def block_links(pivot: int, x: np.ndarray, near: np.ndarray, block: np.ndarray, cross: bool, shared: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of one group: candidates by shared-pivot count whose first common pivot is this list's."""
    step = max(1, 1_000_000 // max(1, len(x)))
    for at in range(0, len(x), step):
        rows = np.arange(at, min(len(x), at + step))
        count = np.zeros((len(rows), len(x)), np.uint8)
        for k in range(near.shape[1]):
            for m in range(near.shape[1]):
                count += near[rows, k, None] == near[None, :, m]
        maybe = count >= shared
        maybe &= (block[rows, None] < block[None, :]) if cross else (rows[:, None] < np.arange(len(x))[None, :])
        a, b = np.nonzero(maybe)
        a = rows[a]
        for cut in range(0, len(a), PAIRS_AT_ONCE):
            p, q = a[cut : cut + PAIRS_AT_ONCE], b[cut : cut + PAIRS_AT_ONCE]
            same = near[p][:, :, None] == near[q][:, None, :]
            first = np.where(same.any(axis=2), near[p], np.iinfo(np.int32).max).min(axis=1)
            keep = first == pivot
            p, q = p[keep], q[keep]
            close = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            yield p[close], q[close]


def _verify(shared: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups (list, pair of blocks) arrive whole and in order."""
        held: list[pd.DataFrame] = []

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            x = _unit(np.array(group["x"].tolist(), np.float64))
            near = np.array(group["near"].tolist(), np.int32)
            ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
            links, at, to = np.zeros(len(x), np.int64), [], []
            cross = bool(group["cross"].iloc[0])
            for p, q in block_links(int(group["pivot"].iloc[0]), x, near, group["block"].to_numpy(), cross, shared, threshold):
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                at.append(ids[p])
                to.append(ids[q])
            a, b = forest(np.concatenate(at), np.concatenate(to)) if at else (ids[:0], ids[:0])
            some = links > 0
            return pd.DataFrame({
                "id": np.r_[ids[some], a], "links": np.r_[links[some], np.zeros(len(a), np.int64)],
                "to": pd.array(np.r_[ids[some], b]),
            })

        def flush(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole = pd.concat(frames, ignore_index=True)
            for _, group in whole.groupby("task", sort=False):
                if len(group) > 1:
                    yield solve(group)

        for batch in batches:
            if not len(batch):
                continue
            last = batch["task"].iloc[-1]
            if held and held[-1]["task"].iloc[-1] == last and batch["task"].iloc[0] == last:
                held.append(batch)
                continue
            done = batch["task"] != last
            yield from flush([*held, batch[done]])
            held = [batch[~done]]
        if held:
            yield from flush(held)

    return run


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, x, copies, dim): one row for each distinct usable vector."""
    x = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("x", lambda v: v != 0.0)
    )
    # -0.0 and 0.0 are one value
    return usable.select("id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x")).groupBy("x").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")
    ).withColumn("dim", F.size("x"))


def find_links(classes: DataFrame, threshold: float, depth: int, shared: int, block: int) -> DataFrame:
    """(id, links, to): partial link counts (to = id) and links (links = 0) between classes."""
    spark = classes.sparkSession
    sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}  # the few lengths of vectors
    pivots = {}
    for dim, n in sizes.items():
        few = classes.where(F.col("dim") == dim).orderBy(fraction_of(F.col("id")), "id").select("x").limit(pivot_count(n))
        pivots[dim] = _unit(np.array([r[0] for r in few.collect()]))  # at most MOST_PIVOTS vectors
    first = {d: sum(len(pivots[e]) for e in pivots if e < d) for d in pivots}
    sent = spark.sparkContext.broadcast((pivots, first))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, starts = sent.value
        for batch in batches:
            rows = batch.to_pandas()
            for dim, part in rows.groupby("dim"):
                near = nearest_pivots(_unit(np.array(part["x"].tolist(), np.float64)), tops[dim], depth) + starts[dim]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["id"]), pa.array(part["x"].tolist(), pa.list_(pa.float64())), pa.array(part["copies"]),
                     pa.array(near.tolist(), pa.list_(pa.int32()))],
                    ["id", "x", "copies", "near"],
                )

    index = materialize(
        classes.select("id", "x", "copies", "dim").mapInArrow(describe, "id long, x array<double>, copies long, near array<int>"), "index"
    )
    lists = index.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n"))  # one row a pivot
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = (
        index.select("id", "x", "copies", "near", F.explode("near").alias("pivot"))
        .join(F.broadcast(lists.where("n > 1").select("pivot", "n")), "pivot")
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "id", "x", "copies", "near", "pivot", "block", (F.col("block") != F.col("other")).alias("cross"),
            F.xxhash64("pivot", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        )
    )
    return spread.repartition("task").sortWithinPartitions("task").mapInPandas(_verify(shared, threshold), "id long, links long, to long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, shared: int = SHARED, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link at a cosine of at least ``threshold`` in double precision if the index finds them;
    no pair below it links, and equal vectors always do. Null or zero vectors, and those with null or
    non-finite components, link with nothing, as do vectors of different lengths. Rows that share a
    vec_id are vectors of their own that count as one node of a component. Rows with a null vec_id
    stay alone, with null component_id. Other columns, labels too, are ignored.
    """
    classes = materialize(_classes(vectors), "classes")
    found = materialize(find_links(classes, threshold, depth, shared, block), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = classes.join(counts, "id", "left").join(nodes.withColumnRenamed("node", "id"), "id", "left").select(
        "x", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "id").alias("_component")
    )
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("x")
    )
    joined = rows.join(known, (rows["x"] == known["x"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
