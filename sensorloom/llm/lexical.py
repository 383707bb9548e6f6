"""Exact ranked lexical search by a dual-tree walk over items and documents.

Documents are reduced to the terms that the items ask for. In a task, documents and items are each put
in a hierarchy whose nodes hold the maximum of every coordinate below them. The product of two nodes' maxima bounds
all scores between them, so a pair of nodes is dropped whole when the bound is below the weakest kth score of
the items in it; what remains at the leaves is scored exactly.

Items are taken in blocks of bounded size. The kth scores start from the exact answer over a part of the
documents, a lower bound of the final one, so most tasks return little more than members.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.tables import bounded_batches
from sensorloom.runtime import materialize

K = 10
#: Weight of a term's share of its document's length, in hundredths, and the units of a term's impact.
LENGTH_PART, UNIT, DAMPING = 75, 1_000_000_000, 8
#: Bytes of item terms in a block, each counted with this many more for its place in the tables.
BLOCK_BYTES, TERM_BYTES = 8 << 20, 64
DOCS_AT_ONCE, DOC_LEAF, DOC_FAN = 4096, 16, 4
ITEM_LEAF, ITEM_FAN = 4, 4
#: One document in so many starts the kth scores.
START_PART = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# UTF-8 bytes: A-Z are lower-cased, ASCII that is no letter or digit separates, all other bytes belong to terms.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The documents' length part m; exact integers beyond 64 bits too."""
    if len(n) and LENGTH_PART * int(n.max()) * n_docs >= 1 << 63:
        return 100 - LENGTH_PART + np.array([LENGTH_PART * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - LENGTH_PART + LENGTH_PART * n * n_docs // max(1, n_terms)


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items: their terms with repeats counted."""
    for batch in batches:
        counts = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("item_id"), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                pa.array([sum(map(len, c)) + TERM_BYTES * len(c) for c in counts], pa.int64()),
            ],
            ["row", "item_id", "terms", "times", "bytes"],
        )


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``items`` (row, bytes) with the ``block`` they are dealt to, of at most ``block_bytes``.

    An item of an eighth of that size or more is a block of its own. The others are dealt to blocks that are
    half full on average, and to more of them until the measured sizes fit.
    """
    large = F.col("bytes") * 8 >= block_bytes
    blocks = max(1, -(-2 * (items.where(~large).agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    while True:
        dealt = items.withColumn("block", F.when(large, -1 - F.col("row")).otherwise(F.pmod(F.xxhash64("row"), F.lit(blocks))).cast("long"))
        sizes = dealt.where("block >= 0").groupBy("block").agg(F.sum("bytes").alias("b"))
        if sizes.where(F.col("b") > block_bytes).isEmpty():
            return dealt
        blocks *= 2


def _index(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents: number of terms, and the terms of the vocabulary with their counts."""
        known = vocabulary.value
        for batch in batches:
            sizes, found, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                sizes.append(len(terms))
                counts = Counter(terms)
                here = [(known[t], counts[t]) for t in (counts.keys() & known.keys())]
                found += [t for t, _ in here]
                times += [c for _, c in here]
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    return run


@dataclass
class Level:
    """Nodes of one level: the maxima of node i are at start[i] to start[i + 1] of terms and most."""

    start: np.ndarray
    terms: np.ndarray
    most: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def only(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of ``nodes``, none of them empty, and where each node begins."""
        lengths = self.start[nodes + 1] - self.start[nodes]
        begin = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) + np.repeat(self.start[nodes] - begin, lengths), begin


def level_of(node: np.ndarray, term: np.ndarray, value: np.ndarray, nodes: int) -> Level:
    """Maxima by (node, term)."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(value, first) if len(first) else value
    return Level(np.searchsorted(node[first], np.arange(nodes + 1)), term[first], most)


def tree(rows: np.ndarray, term: np.ndarray, value: np.ndarray, count: int, leaf: int, fan: int) -> tuple[np.ndarray, list[Level]]:
    """Order of the rows, and levels from the rows themselves up to one root.

    Rows with the same two heaviest terms lie side by side, so that the maxima of their node stay close to them.
    """
    heavy = np.full((count, 2), -1, np.int64)
    ranked = np.lexsort((-value, rows))
    begin = np.searchsorted(rows[ranked], np.arange(count + 1))
    for k in range(2):
        has = begin[1:] - begin[:-1] > k
        heavy[has, k] = term[ranked[begin[:-1][has] + k]]
    order = np.lexsort((heavy[:, 1], heavy[:, 0]))
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    node, size, levels = place[rows], count, []
    levels.append(level_of(node, term, value, size))
    width = leaf
    while size > 1:
        below = levels[-1]
        node = np.repeat(np.arange(len(below)), np.diff(below.start)) // width
        size = -(-size // width)
        levels.append(level_of(node, below.terms, below.most, size))
        width = fan
    return order, levels


class Items:
    """The items of a block in their hierarchy, with the k best documents of each so far."""

    def __init__(self, rows: np.ndarray, item: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, start: np.ndarray, k: int):
        self.k, self.weights = k, weights
        # ordered by weight, but a node's maxima are of the times alone: the documents' side carries the weights
        self.order, _ = tree(item, term, times * weights[term], len(rows), ITEM_LEAF, ITEM_FAN)
        place = np.empty(len(rows), np.int64)
        place[self.order] = np.arange(len(rows))
        self.levels = [level_of(place[item], term, times, len(rows))]
        width, size = ITEM_LEAF, len(rows)
        while size > 1:
            below = self.levels[-1]
            size = -(-size // width)
            node = np.repeat(np.arange(len(below)), np.diff(below.start)) // width
            self.levels.append(level_of(node, below.terms, below.most, size))
            width = ITEM_FAN
        self.rows = rows[self.order]
        self.start = start[self.order]
        self.kth = self.start.copy()  # 0: fewer than k are known
        self.best = [np.zeros((3, 0), np.int64) for _ in rows]  # scores, whether the id is null, id

    def weakest(self, level: int) -> np.ndarray:
        """The weakest kth score of the items in each node."""
        out, width = self.kth, ITEM_LEAF
        for _ in range(level):
            out, width = np.minimum.reduceat(out, np.arange(0, len(out), width)), ITEM_FAN
        return out

    def offer(self, item: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best of these documents too; equal scores by id, null ids last."""
        new = np.concatenate([self.best[item], np.stack([scores, null, ids])], axis=1)
        new = new[:, np.lexsort((new[2], new[1], -new[0]))][:, : self.k]
        self.best[item] = new
        if new.shape[1] == self.k:
            self.kth[item] = max(self.kth[item], new[0, -1])


class Documents:
    """Up to DOCS_AT_ONCE documents in their hierarchy."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        order, self.levels = tree(doc, term, value, len(ids), DOC_LEAF, DOC_FAN)
        self.ids, self.null = ids[order], null[order]


def bounds(query: np.ndarray, level: Level, nodes: np.ndarray) -> np.ndarray:
    """Products of the dense maxima ``query`` with those of each of ``nodes``."""
    filled = level.start[nodes + 1] > level.start[nodes]
    out = np.zeros(len(nodes), np.int64)
    if filled.any():
        at, begin = level.only(nodes[filled])
        out[filled] = np.add.reduceat(query[level.terms[at]] * level.most[at], begin)
    return out


def walk(items: Items, docs: Documents) -> tuple[int, int]:
    """Bring the items' best documents up to date; returns the pairs scored and all pairs."""
    dense = np.zeros(len(items.weights), np.int64)
    down = [(len(items.levels) - 1, 0, len(docs.levels) - 1, np.zeros(1, np.int64))] if len(items.rows) and len(docs.ids) else []
    scored = 0
    while down:
        level, node, doc_level, doc_nodes = down.pop()
        own = items.levels[level]
        at = slice(own.start[node], own.start[node + 1])
        dense[own.terms[at]] = own.most[at]
        weakest = max(1, items.weakest(level)[node])
        # the documents' side first: descend to its rows while this node's bound lets fewer through
        while True:
            limit = bounds(dense, docs.levels[doc_level], doc_nodes)
            kept = limit >= weakest
            doc_nodes, limit = doc_nodes[kept], limit[kept]
            if not len(doc_nodes) or doc_level == 0 or (level > 0 and doc_level <= level):
                break
            fan = DOC_LEAF if doc_level == 1 else DOC_FAN
            doc_nodes = (doc_nodes[:, None] * fan + np.arange(fan)).ravel()
            doc_level -= 1
            doc_nodes = doc_nodes[doc_nodes < len(docs.levels[doc_level])]
        dense[own.terms[at]] = 0
        if not len(doc_nodes):
            continue
        if level == 0:
            scored += len(doc_nodes)
            items.offer(node, limit, docs.null[doc_nodes], docs.ids[doc_nodes])
            continue
        fan = ITEM_LEAF if level == 1 else ITEM_FAN
        for child in range(node * fan, min(node * fan + fan, len(items.levels[level - 1]))):
            down.append((level - 1, child, doc_level, doc_nodes))
    return scored, len(items.rows) * len(docs.ids)


def _rank(sent, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value, k)
        for batch in batches:
            for low in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(low, DOCS_AT_ONCE)
                counts = np.diff(np.asarray(some.column("terms").offsets))
                doc = np.repeat(np.arange(some.num_rows), counts)
                term = np.asarray(some.column("terms").flatten()).astype(np.int64)
                tf = np.asarray(some.column("tfs").flatten()).astype(np.int64)
                m = length_terms(np.asarray(some.column("n")), n_docs, n_terms)
                value = items.weights[term] * (UNIT * tf // (1000 * tf + DAMPING * m[doc]))
                ids = some.column("doc_id")
                null = np.asarray(ids.is_null()).astype(np.int64)
                walk(items, Documents(np.asarray(ids.fill_null(0)), null, doc, term, value))
        for row, best in zip(items.rows, items.best):
            scores, null, ids = best
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), row)), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], ["row", "doc_id", "score"]
                )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(row, doc_id, score, rank) for the items of one block, whose size is bounded."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    item, term, times = [], [], []
    for i, row in enumerate(items):
        for t, n in zip(row["terms"], row["times"]):
            item.append(i)
            term.append(vocabulary.setdefault(bytes(t), len(vocabulary)))
            times.append(n)
    counted = materialize(
        bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_index(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>")
        .withColumn("start", F.pmod(F.xxhash64("doc_id", "n", "terms", "tfs"), F.lit(START_PART)) == 0),
        "terms",
    )
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most one row a term of the block
    weights = np.array([weight_of(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    rows = np.array([r["row"] for r in items], np.int64)
    arrays = [rows, *(np.array(x, np.int64) for x in (item, term, times)), weights]
    wanted = counted.where(F.size("terms") > 0)

    def over(part: DataFrame, start: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((*arrays, start))
        return part.select("doc_id", "n", "terms", "tfs").mapInArrow(_rank(sent, n_docs, n_terms, k), "row long, doc_id long, score long")

    first = over(wanted.where("start"), np.zeros(len(rows), np.int64))
    least = {r["row"]: r["score"] for r in _best(first, k).where(F.col("rank") == k).collect()}  # one score an item of the block
    return _best(over(wanted, np.array([least.get(r, 0) for r in rows.tolist()], np.int64)), k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents (doc_id, text) for each row of ``items`` (item_id, text).

    Terms are runs of letters, digits and non-ASCII characters of the whole text, A-Z lower-cased. A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), N the documents with terms, df those that hold it; a document of n terms
    gets for each term of the item, repeats included, the weight times (10^9 tf) div (1000 tf + 8 m), m being 25
    plus 75 n N div L, L the terms of all documents. Returns item_id, rank (from 1), doc_id, score > 0, highest first,
    equal scores by doc_id, null ids last; fewer rows if fewer documents share a term with the item. Null and empty texts have no terms:
    such a document is never found, such an item finds nothing. Repeated rows are documents or items of their own.
    Other columns are ignored.
    """
    numbered = materialize(
        bounded_batches(items).select(F.monotonically_increasing_id().alias("row"), F.col("item_id"), F.col("text").cast("string")), "items"
    )
    kind = numbered.schema["item_id"].dataType.simpleString()
    counted = materialize(
        numbered.mapInArrow(_count_all, f"row long, item_id {kind}, terms array<binary>, times array<long>, bytes long"), "item-terms"
    )
    dealt = item_blocks(counted.where(F.size("terms") > 0), block_bytes)
    ranked = None
    for (block,) in dealt.select("block").distinct().collect() or [(0,)]:  # one number a block
        some = dealt.where(F.col("block") == block).select("row", "terms", "times").collect()  # at most block_bytes, or one item
        part = _rank_block(docs, some, k)
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.join(counted.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = rf"""
with dt as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
bt as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
q as (select item_id, term, count(*) as times from (select item_id, unnest(t) as term from bt) group by all),
c as (select count(*) filter (len(t) > 0) as n_docs, sum(len(t))::hugeint as n_terms from dt),
m as (select row, doc_id, 100 - {LENGTH_PART} + ({LENGTH_PART} * len(t)::hugeint * n_docs) // n_terms as m from dt, c where len(t) > 0),
f as (select row, term, count(*)::hugeint as tf from (select row, unnest(t) as term from dt) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::hugeint as w from f, c group by term, n_docs),
s as (select item_id, doc_id, sum(times * w * (({UNIT} * tf) // (1000 * tf + {DAMPING} * m)))::bigint as score
  from q join w using (term) join f using (term) join m using (row) group by item_id, row, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
qualify rank <= {K}
"""
