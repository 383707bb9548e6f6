"""Exact top-k search over an impact-ordered index, score at a time.

Every component of the vectors of a shard is a posting of its dimension; postings of about equal value
form a segment with one quantised impact. As every vector has a posting in every dimension, a query counts
impacts from what the fullest segment of the dimension gives, up or down. It weighs the segments of all dimensions and
processes them by falling size of impact, whatever their dimension, the fullest ones last. After each stretch of
segments the vectors' bounds are compared: a vector can still gain or lose at most the impact of the next segment in
each dimension where it has not been met. The query stops when this proves that few vectors can be members, and scores
these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import blocks

FACTOR = 64
K = 20
EVERY = 20
LEVELS = 128
#: Parts of the postings after which a query compares the bounds.
CHECKS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Vectors that may be left for exact scoring when a query stops, as a part of the shard.
REST = 64


class Index:
    """Posting segments of one shard: for each dimension the vectors by level, with the exact range of each level."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.rows, self.ids, self.x = rows, ids, x
        n, dim = x.shape
        self.levels = levels
        self.order = np.zeros((dim, n), np.intp)
        self.start = np.zeros((dim, levels + 1), np.int64)
        self.low, self.high = np.zeros((dim, levels), np.int64), np.full((dim, levels), -1, np.int64)
        for d in range(dim):
            values = x[:, d]
            least = int(values.min())
            step = max(1, -(-(int(values.max()) - least + 1) // levels))
            level = (values - least) // step
            self.order[d] = np.argsort(level, kind="stable")
            counts = np.bincount(level, minlength=levels)
            self.start[d, 1:] = np.cumsum(counts)
            used = np.flatnonzero(counts)
            grouped = values[self.order[d]]
            self.low[d, used] = np.minimum.reduceat(grouped, self.start[d, used])
            self.high[d, used] = np.maximum.reduceat(grouped, self.start[d, used])
        self.sizes = np.diff(self.start, axis=1)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and exact scores of the ``k`` best vectors but row ``own``, and the postings processed."""
        n, dim = self.x.shape
        weight = query[:, None]
        used = self.sizes > 0
        ends = np.stack([weight * self.low, weight * self.high])
        least, most = ends.min(axis=0), ends.max(axis=0)
        fullest = self.sizes.argmax(axis=1)[:, None] if dim else np.zeros((0, 1), np.int64)
        middle = least + ((most - least) >> 1)
        middle -= np.take_along_axis(middle, fullest, 1)
        # quantised to units that leave room for the count of dimensions met
        hit_bits = dim.bit_length()
        wide = np.where(used, np.abs(middle), 0)
        shift = max(0, int(wide.max(axis=1).astype(object).sum()).bit_length() + hit_bits - 60) if dim else 0
        impact = middle >> shift
        # what a met dimension may add to or take from its quantised impact, and what one not met may
        error = ((np.where(used, most - least, 0).max(axis=1) + 1 >> 1) >> shift) + 2 * (shift > 0)
        slack = int(error.astype(object).sum())
        reach = np.abs(impact) + error[:, None]
        segments = np.flatnonzero(used.ravel())
        segments = segments[np.argsort(-reach.ravel()[segments], kind="stable")]
        gains, reaches, lengths = (a.ravel()[segments] for a in (impact, reach, self.sizes))
        done_after = np.cumsum(lengths)
        total = int(done_after[-1]) if len(segments) else 0
        stops = np.searchsorted(done_after, [total * part for part in CHECKS])
        mine = np.searchsorted(self.rows, own)
        mine = mine if mine < n and self.rows[mine] == own else -1
        met = np.zeros(n, np.int64)  # impacts so far, above the bits that count the dimensions met
        steps, mask = (gains << hit_bits) + 1, (1 << hit_bits) - 1
        maybe, at = np.ones(n, bool), 0
        for stop in stops:
            for segment, step in zip(segments[at : stop + 1].tolist(), steps[at : stop + 1].tolist()):
                d, level = divmod(segment, self.levels)
                met[self.order[d, self.start[d, level] : self.start[d, level + 1]]] += step
            at = min(max(at, int(stop) + 1), len(segments))
            open_ = (dim - (met & mask)) * (int(reaches[at]) if at < len(segments) else 0) + slack
            gained = met >> hit_bits
            surest = gained - open_
            if mine >= 0:
                surest[mine] = np.iinfo(np.int64).min
            if n > k:
                maybe = gained + open_ >= np.partition(surest, n - k)[n - k]
            if maybe.sum() <= max(4 * k, n // REST):
                break
        if mine >= 0:
            maybe[mine] = False
        members = np.flatnonzero(maybe)
        scores = self.x[members] @ query
        chosen = blocks.best(scores, self.ids[members], k)
        return members[chosen], scores[chosen], int(done_after[at - 1]) if at else 0


def _search(k: int, levels: int):
    def build(candidates: pa.Table) -> Index:
        dim = candidates["dim"][0].as_py()
        return Index(np.asarray(candidates["row"]), np.asarray(candidates["id"]), blocks.matrix(candidates["v"], dim), levels)

    def answer(index: Index, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, ids = np.asarray(queries.column("row")), np.asarray(queries.column("id"))
        found = [index.search(int(r), v, k)[:2] for r, v in zip(rows, blocks.matrix(queries.column("v"), index.x.shape[1]))]
        counts = [len(at) for at, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(rows, counts)), pa.array(np.repeat(ids, counts)),
                pa.array(np.concatenate([index.ids[at] for at, _ in found])), pa.array(np.concatenate([s for _, s in found])),
            ],
            ["row", "query_id", "vec_id", "score"],
        )

    return lambda batches: blocks.run_tasks(batches, ["dim"], build, answer)


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, factor: int = FACTOR,
    levels: int = LEVELS, shard_values: int = blocks.SHARD_VALUES,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, embedding) for each row whose vec_id ``every`` divides.

    Returns query_id, rank (from 1), vec_id, score: the inner product of floor(factor * x), ties to the smaller
    vec_id, all other rows if they are fewer than ``k``. Rows with a null vec_id or vector, or with a null or
    non-finite component, take no part, nor do vectors whose integers have a squared length above 2^58.
    Vectors are compared with those of their own length only. Rows that repeat a vec_id are rows of their own: each
    is a candidate for the others and a query of its own. Other columns are ignored.
    """
    rows = blocks.integer_vectors(vectors, factor)
    dealt = blocks.deal(rows, rows.where(F.col("id") % every == 0), ["dim"], shard_values)
    found = dealt.mapInArrow(_search(k, levels), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
with v as (select vec_id, [floor({FACTOR} * x::double) for x in embedding] as w from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= {K}
"""
