"""SimHash near-dedup: 64-bit fingerprints joined by a binary trie over their bits.

Fingerprints within ``budget`` differing bits agree on at least one of ``budget + 1``
blocks of bits (pigeonhole), so each block's exact value is a trie node paired with
itself at no cost. From there node pairs are traversed together: a pair of nodes carries
the bits in which their paths differ and is pruned once they exceed the budget. The upper
levels are a shuffle: a node pair that holds more than ``group_limit`` fingerprints is
split by its next bits into smaller node pairs, round by round, so no task gets a hot node
whole. The lower levels run in numpy, all node pairs of a batch of groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.components import connected_components, forest
from sensorloom.llm.tables import id_and_text
from sensorloom.runtime import materialize

WORDS_PER_SHINGLE = 3
BUDGET = 2
GROUP_LIMIT = 4096
STEP_BITS = 4
SEED = 42
NODE = "group long, key long, print long, bits int, errors int, side int"
NODE_NAMES = ["group", "key", "print", "bits", "errors", "side"]
NODE_TYPES = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]


def fingerprint(text: str | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """SimHash of one text; no words (or null) give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    total, counts = len(words) - k + 1, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, total)
    for at in range(0, total, 4096):  # bit sums of a bounded slice of shingles at a time
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the signed 64-bit fingerprint of each row's whole text."""
    return id_and_text(docs).mapInArrow(
        _fingerprints, "doc_id long, print long"
    )


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the budget + 1 blocks, highest bits first."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(budget + 1)]


def _rotated(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
    """The bits with block (shift, width) moved to the top, the rest below it in order."""
    if width == 64:
        return prints.copy()
    high = prints >> np.uint64(shift) & np.uint64((1 << width) - 1)
    above = prints >> np.uint64(shift + width) if shift + width < 64 else np.zeros_like(prints)
    below = prints & np.uint64((1 << shift) - 1)
    return high << np.uint64(64 - width) | above << np.uint64(shift) | below


def trie_links(keys: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of one group whose keys differ in at most ``budget`` bits.

    ``keys`` (unsigned 64-bit) are sorted within ``groups``, which are contiguous. A range of
    sorted keys with a common prefix is a trie node. The frontier holds node pairs with the
    count of differing bits on the way down.
    """
    out_a, out_b = [], []
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(keys)]
    big = ends - starts > 1
    frontier = [(starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), np.int64), 63)]
    while frontier:
        a0, a1, b0, b1, errors, bit = frontier.pop()
        if not len(a0):
            continue
        small = ((a1 - a0) * (b1 - b0) <= 64) | (bit < 0)
        if small.any():  # few leaves below: compare them outright
            for x, y in _leaves(a0[small], a1[small], b0[small], b1[small]):
                near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
                out_a.append(x[near])
                out_b.append(y[near])
        go = ~small
        a0, a1, b0, b1, errors = a0[go], a1[go], b0[go], b1[go], errors[go]
        if not len(a0):
            continue
        am, bm = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        own = a0 == b0  # a node with itself: its two children meet once, not twice
        parts = [
            (a0, am, b0, bm, errors, np.ones(len(a0), bool)),
            (am, a1, bm, b1, errors, np.ones(len(a0), bool)),
            (a0, am, bm, b1, errors + 1, np.ones(len(a0), bool)),
            (am, a1, b0, bm, errors + 1, ~own),
        ]
        merged = []
        for p0, p1, q0, q1, e, keep in parts:
            keep = keep & (p1 > p0) & (q1 > q0) & (e <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            merged.append((p0[keep], p1[keep], q0[keep], q1[keep], e[keep]))
        nxt = [np.concatenate(x) for x in zip(*merged)]
        for at in range(0, len(nxt[0]), 500_000):  # depth first over slices: a bounded frontier
            frontier.append((*(x[at : at + 500_000] for x in nxt), bit - 1))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index of each node's keys that have ``bit`` set."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = open_ & (keys[np.minimum(mid, len(keys) - 1)] & mask != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _leaves(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs below node pairs, x before y for a node with itself, in bounded slices."""
    width = b1 - b0
    for at in range(0, len(a0), 20_000):
        s = slice(at, at + 20_000)
        count = (a1[s] - a0[s]) * width[s]
        pair = np.repeat(np.arange(len(count)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x, y = a0[s][pair] + nth // width[s][pair], b0[s][pair] + nth % width[s][pair]
        keep = (a0[s][pair] != b0[s][pair]) | (x < y)
        yield x[keep], y[keep]


def _lower_levels(budget: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive whole and in order; a batch of them is traversed at once."""
        rest = None

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            group = part["group"].to_numpy()
            keys = part["key"].to_numpy().view(np.uint64)
            prints = part["print"].to_numpy()
            order = np.lexsort((keys, group))
            x, y = trie_links(keys[order], group[order], budget)
            a, b = forest(prints[order][x], prints[order][y]) if len(x) else (x, y)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rest["group"].iloc[-1] if len(rest) else None
            done = rest["group"] != last
            if len(rest) > 200_000 and done.any():
                yield solve(rest[done])
                rest = rest[~done].reset_index(drop=True)
        if rest is not None and len(rest):
            yield solve(rest)

    return links


def fingerprint_links(prints: DataFrame, budget: int = BUDGET, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``print``) that connect all within ``budget`` bits.

    Each group of the last level yields a forest over its links, which reaches the same
    fingerprints as all of them.
    """
    spark = prints.sparkSession
    distinct = materialize(prints.select("print").where("print is not null").distinct(), "prints")
    blocks = _blocks(budget)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64)
            zero = np.zeros(len(p), np.int32)
            for j, (shift, width) in enumerate(blocks):
                key = _rotated(p, shift, width)
                group = (key >> np.uint64(64 - width)) * np.uint64(len(blocks)) + np.uint64(j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (group.view(np.int64), key.view(np.int64), p.view(np.int64),
                                           np.full(len(p), 64 - width, np.int32), zero, zero)],
                    NODE_NAMES,
                )

    frontier = distinct.mapInArrow(start, NODE)
    links = None
    for _ in range(64 // STEP_BITS + 1):
        nodes = materialize(frontier, "nodes")
        big = nodes.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("group")
        hot = materialize(big, "hot")
        any_hot = bool(hot.take(1))
        rest = nodes.join(hot, "group", "left_anti") if any_hot else nodes
        found = (
            rest.repartition("group").sortWithinPartitions("group")
            .select("group", "key", "print").mapInPandas(_lower_levels(budget), "a long, b long")
        )
        links = found if links is None else links.union(found)
        if not any_hot:
            break
        frontier = nodes.join(hot, "group", "left_semi").mapInArrow(_split(budget), NODE)
    return links


def _split(budget: int):
    """The next bits of hot node pairs: a fingerprint joins each pair its own child may be half of.

    ``side`` is 0 in a node paired with itself, else 1 or 2 for the half a fingerprint is in.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, key, prints, left, errors, side = (batch.column(i).to_numpy() for i in range(6))
            step = np.minimum(STEP_BITS, left)
            child = (key.view(np.uint64) >> (left - step).astype(np.uint64)).astype(np.int64) & ((1 << step) - 1)
            for x in range(1 << STEP_BITS):
                other, spent = child ^ x, errors + x.bit_count()
                ok = (x < (1 << step)) & (spent <= budget)
                half = np.where(side == 0, np.where(x == 0, 0, np.where(child < other, 1, 2)), side)
                pair = np.where(half == 2, other << STEP_BITS | child, child << STEP_BITS | other)
                mixed = _mix(group.view(np.uint64), pair.view(np.uint64)).view(np.int64)
                columns = [mixed, key, prints, left - step, spent, half]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[ok].astype(t)) for c, t in zip(columns, NODE_TYPES)], NODE_NAMES
                )

    return split


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a node pair below a group: two names that meet only cost more comparisons."""
    with np.errstate(over="ignore"):
        x = (a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ b
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(32)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Rows link when their fingerprints differ in at most ``budget`` bits; ``component_id`` is the
    smallest doc_id reachable over links. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows and rows that share a doc_id stay rows of their own. A row with
    a null doc_id takes part; it lends no id, so a component of such rows alone has a null
    component_id. Other columns are ignored; an empty table gives no rows.
    """
    marked = materialize(with_fingerprints(docs), "marked")
    classes = marked.groupBy("print").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(fingerprint_links(marked, budget, group_limit))
    classes = materialize(
        classes.join(nodes.withColumnRenamed("node", "print"), "print", "left")
        .select("print", "least", F.coalesce("component", "print").alias("component")),
        "classes",
    )
    reach = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = classes.join(reach, "component").select("print", "component_id")
    return marked.join(of_print, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that represent their component: those whose doc_id is its component_id.

    Rows that share that doc_id all stay, and so do rows with a null doc_id, which no id could name.
    """
    groups = near_duplicates(docs, budget)
    own = F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    dropped = groups.where("doc_id is not null").groupBy("doc_id").agg(own.alias("own")).where("not own").select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped_id"], "left_anti")
