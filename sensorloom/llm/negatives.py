"""Hard negatives by exact scores from a residue number system.

Integer vectors are split into residues modulo several small primes. A matrix product of residues fits
float32 without rounding, so each prime costs one fast product, and the signed score follows from the
residues by Chinese remaindering in mixed radix. Primes are taken until their product exceeds twice the
largest possible score. Positives are found first; they set the window of scores that negatives must lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import blocks
from sensorloom.runtime import materialize

FACTOR = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: The window of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
LARGEST_PRIME = 1021
#: Columns whose products of centred residues add up below 2^24, which float32 holds exactly.
EXACT_COLUMNS = ((1 << 24) - 1) // ((LARGEST_PRIME - 1) // 2) ** 2
QUERIES_AT_ONCE = 64
#: A matrix product takes less time than bringing a shard to one more task for fewer anchors than this.
LEAST_PART = 256


@cache
def primes() -> list[int]:
    """Odd primes up to LARGEST_PRIME, largest first."""
    sieve = np.ones(LARGEST_PRIME + 1, bool)
    sieve[:2] = False
    for p in range(2, int(LARGEST_PRIME**0.5) + 1):
        sieve[p * p :: p] &= not sieve[p]
    return [int(p) for p in np.flatnonzero(sieve)[:0:-1]]


def moduli(bound: int) -> list[int]:
    """The fewest largest primes that tell all integers from -bound to bound apart."""
    taken, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        taken.append(p)
        product *= p
    return taken


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    half = (p - 1) // 2
    return (values + half) % p - half


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [centred(x, p).astype(np.float32) for p in moduli]


def signed(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers with these residues, smallest in size: digits in mixed radix, each centred."""
    digits: list[np.ndarray] = []
    for j, p in enumerate(moduli):
        digit = parts[j]
        for i in range(j):
            digit = (digit - digits[i]) % p * pow(moduli[i], -1, p)
        digits.append(centred(digit, p))
    out = np.zeros_like(digits[0]) if digits else np.zeros_like(parts)
    for digit, p in zip(reversed(digits), reversed(moduli)):
        out = out * p + digit
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact integer scores (rows of a, rows of b) from the residues of both."""
    parts = []
    for p, left, right in zip(moduli, a, b):
        whole = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, left.shape[1], EXACT_COLUMNS):
            whole += (left[:, at : at + EXACT_COLUMNS] @ right[:, at : at + EXACT_COLUMNS].T).astype(np.int64)
        parts.append(whole)
    return signed(parts, moduli)


class Shard:
    """Candidates of a task with their residues, which are made for the primes that the queries so far have needed."""

    def __init__(self, rows: pa.Table):
        dim = rows["dim"][0].as_py()
        self.rows, self.ids, self.labels = (np.asarray(rows[c]) for c in ("row", "id", "label"))
        self.x = blocks.matrix(rows["v"], dim)
        self.square = _largest_square(self.x)
        self.parts: list[np.ndarray] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        # by Cauchy and Schwarz no score exceeds the product of the lengths
        needed = moduli(int((self.square * _largest_square(x)) ** 0.5 * (1 + 1e-9)) + 1)
        self.parts += residues(self.x, needed[len(self.parts) :])
        return product(residues(x, needed), self.parts, needed)


def _largest_square(x: np.ndarray) -> float:
    wide = x.astype(np.float64)
    return float(np.einsum("ij,ij->i", wide, wide).max(initial=0.0)) * (1 + 1e-9)


def _batches(queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, queries.num_rows, QUERIES_AT_ONCE):
        yield queries.slice(at, QUERIES_AT_ONCE)


def _positives(k: int):
    def answer(shard: Shard, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in _batches(queries):
            rows = np.asarray(some.column("row"))
            scores = shard.scores(blocks.matrix(some.column("v"), shard.x.shape[1]))
            out = []
            for i, row in enumerate(rows):
                others = np.flatnonzero(shard.rows != row)
                at = others[blocks.best(scores[i, others], shard.ids[others], k)]
                out.append((np.full(len(at), row), shard.rows[at], shard.ids[at], scores[i, at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "positive_row", "positive_id", "positive_score"])

    return lambda batches: blocks.run_tasks(batches, ["dim", "label"], Shard, answer)


def window_of(positive: int, lowest: int, highest: int) -> tuple[int, int]:
    """Least and greatest score with lowest * positive <= 100 * score <= highest * positive."""
    return -(-lowest * positive // 100), highest * positive // 100


def _negatives(k: int, lowest: int, highest: int):
    def answer(shard: Shard, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in _batches(queries):
            rows, labels = np.asarray(some.column("row")), np.asarray(some.column("label"))
            scores = shard.scores(blocks.matrix(some.column("v"), shard.x.shape[1]))
            positives = some.column("positives").to_pylist()
            out = [(np.zeros(0, np.int64),) * 4]
            for i, row in enumerate(rows):
                other = np.flatnonzero(shard.labels != labels[i])
                found = scores[i, other]
                for positive in positives[i]:
                    low, high = window_of(positive["positive_score"], lowest, highest)
                    at = other[(found >= low) & (found <= high)]
                    at = at[blocks.best(scores[i, at], shard.ids[at], k)]
                    out.append((np.full(len(at), row), np.full(len(at), positive["positive_row"]), shard.ids[at], scores[i, at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "positive_row", "negative_id", "negative_score"])

    return lambda batches: blocks.run_tasks(batches, ["dim"], Shard, answer)


def noisy_labels(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the label of every row whose vec_id 7 divides moved on by one, of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, factor: int = FACTOR,
    window: tuple[int, int] = (LOWEST, HIGHEST), is_anchor: Column | None = None, shard_values: int = blocks.SHARD_VALUES,
) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, embedding, label) for each anchor and positive.

    Anchors are the rows whose vec_id ``every`` divides, or those where ``is_anchor`` (over id, label, dim) holds. A
    score is the inner product of floor(factor * x). An anchor's positives are the ``positives`` best other rows of its
    label; the negatives of a pair are the ``negatives`` best rows of other labels with a score from window[0] to
    window[1] hundredths of the positive's score; a positive with a negative score has none. Ties go to the smaller vec_id. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector or with a null or non-finite component take no part, nor do
    vectors whose integers have a squared length above 2^58. Only vectors of equal length are compared. Rows that
    repeat a vec_id are rows of their own, as anchors, positives and negatives. Other columns are ignored.
    """
    rows = blocks.integer_vectors(vectors.where("label is not null"), factor, "label").withColumn("label", F.col("label").cast("long"))
    anchors = rows.where(F.col("id") % every == 0 if is_anchor is None else is_anchor)
    near = blocks.deal(rows, anchors, ["dim", "label"], shard_values, LEAST_PART).mapInArrow(
        _positives(positives), "row long, positive_row long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    pairs = materialize(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth"), "positives")
    asked = anchors.join(pairs.groupBy("row").agg(F.collect_list(F.struct("positive_row", "positive_score")).alias("positives")), "row")
    found = blocks.deal(rows, asked.select(*rows.columns, "positives"), ["dim"], shard_values, LEAST_PART).mapInArrow(
        _negatives(negatives, *window), "row long, positive_row long, negative_id long, negative_score long"
    )
    rank = F.row_number().over(Window.partitionBy("row", "positive_row").orderBy(F.desc("negative_score"), "negative_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return best.join(pairs, ["row", "positive_row"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE_SQL = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor({FACTOR} * x::double) for x in embedding] as w from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.w, c.w)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % {EVERY} = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same
  and {LOWEST} * positive_score <= 100 * score and 100 * score <= {HIGHEST} * positive_score
qualify rank <= {NEGATIVES}
"""
