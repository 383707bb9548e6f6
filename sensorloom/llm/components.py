"""Connected components of a link table, without bringing links to the driver.

Every partition first contracts its links to a forest, then large-star and small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond") run until every
node points at the smallest node of its component. A node's smallest neighbour is an
aggregate with a map-side combine, and its links meet it in a join that adaptive
execution may split, so a hub with a third of all links is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.runtime import materialize

EDGE = "a long, b long"
MAX_ROUNDS = 100


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest node index reachable over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace links by one link from each node to the smallest node it reaches over them."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest_labels(codes[: len(a)], codes[len(a) :], len(nodes))
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_a, kept_b, waiting, pending = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def fold() -> None:
        nonlocal kept_a, kept_b, waiting, pending
        a = np.concatenate([kept_a, *(x for x, _ in waiting)])
        b = np.concatenate([kept_b, *(y for _, y in waiting)])
        kept_a, kept_b = forest(a, b) if len(a) else (a, b)
        waiting, pending = [], 0

    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        pending += batch.num_rows
        if pending > 1_000_000:
            fold()
            if len(kept_a) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], ["a", "b"])
                kept_a, kept_b = kept_a[:0], kept_b[:0]
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over links a > b."""
    if large:
        seen = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select("a", "b")
    # written first, so that the join deals out both sides anew and may split a hub
    low = materialize(seen.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node"), "low")
    met = seen.join(low, F.col("a") == F.col("node"))
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    else:
        out = met.select(
            F.explode(
                F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), F.col("low")))
            ).alias("e")
        ).select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component: smallest node reached.

    Nodes without a link are absent. Null ends, links of a node to itself and repeated
    links are ignored; no links give no rows.
    """
    clean = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = materialize(clean.mapInArrow(_contract, EDGE), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_star(_star(edges, True), False), "links")
        state = edges.agg(
            F.count("*"), F.sum(F.hash("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))
        ).first()
        if state[0] == 0 or state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
