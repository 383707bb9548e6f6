"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of hashed byte trigrams, of n-grams of word shapes and of repetition are scaled by
the log ratio of their (smoothed) counts in good and bad labelled documents; a linear model with
hinge loss is fitted to the scaled vectors by dual coordinate descent, and its margins become
probabilities by a logistic fit on labelled rows that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import bounded_batches, fraction_of, id_and_text, remainder

TRIGRAMS = 1 << 15
SHAPES = 1 << 13
REPEATS = 64
SIZE = TRIGRAMS + SHAPES + REPEATS
ROWS_PER_CLASS = 2500
HELD_OUT_PARTS, HELD_OUT_PART = 5, 0
THRESHOLD = 0.3
EPOCHS = 12
COST = 4.0


def _shape_table() -> np.ndarray:
    """Class of each byte: letters by case, digits, blanks and high bytes fall together, signs stay apart."""
    table = np.arange(256, dtype=np.uint32) + 16
    table[[*range(ord("a"), ord("z") + 1)]] = 0
    table[[*range(ord("A"), ord("Z") + 1)]] = 1
    table[[*range(ord("0"), ord("9") + 1)]] = 2
    table[[32, 9, 13]] = 3
    table[10] = 4
    table[128:] = 0
    return table


SHAPE = _shape_table()


def _slots(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Hash of several aligned code arrays, below ``size`` (a power of two)."""
    mixed = np.zeros(len(parts[0]), np.uint32)
    for part in parts:
        mixed = (mixed ^ part) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(size - 1)


def indicators(text: str | None) -> np.ndarray:
    """Sorted ids of the features that a whole text has; an empty or null text has none."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int32)
    seen = np.zeros(SIZE, bool)
    wide = raw.astype(np.uint32)
    if len(raw) > 2:
        seen[_slots([wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)], TRIGRAMS)] = True
    shape = SHAPE[raw]
    shape = shape[np.r_[True, (shape[1:] != shape[:-1]) | (shape[1:] > 3)]]
    for n in (2, 4):
        if len(shape) >= n:
            seen[TRIGRAMS + _slots([shape[k : len(shape) - n + 1 + k] for k in range(n)], SHAPES)] = True
    words = text.split()
    if words:
        same = sum(map(str.__eq__, words[1:], words)) / len(words)
        kinds = len(set(words)) / len(words)
        at = TRIGRAMS + SHAPES
        seen[[at + min(15, int(same * 16)), at + 16 + min(15, int(kinds * 16)), at + 32 + min(15, len(words).bit_length())]] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weight of each indicator (ratio times hinge weight), its squared ratio, bias and logistic fit."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        norm = np.sqrt(self.square[ids].sum()) or 1.0
        return float(self.weight[ids].sum() / norm + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed share in good rows to that in bad ones."""
    counts = [np.ones(SIZE), np.ones(SIZE)]
    for ids, y in zip(rows, good):
        counts[int(y)][ids] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_hinge(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent (Hsieh et al. 2008) for the hinge loss on unit-length scaled indicators."""
    sign = np.where(good, 1.0, -1.0)
    values = []
    for ids in rows:
        x = ratio[ids]
        values.append(x / (np.sqrt(x @ x) or 1.0))
    cost = COST * np.where(good, len(good) / max(1, 2 * good.sum()), len(good) / max(1, 2 * (~good).sum()))
    weight, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i], values[i]
            gradient = sign[i] * (weight[ids] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[ids] += step * x
                bias += step
                alpha[i] = new
    return weight, bias


def fit_logistic(margins: np.ndarray, good: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of ``good``, by Newton steps with a weak prior."""
    theta, x = np.array([1.0, 0.0]), np.c_[margins, np.ones(len(margins))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (importance * (good - p)) - 0.01 * theta
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, gradient), -5, 5)
    return max(theta[0], 1e-3), theta[1]


def train(rows: list[np.ndarray], good: np.ndarray, share_good: float) -> Model:
    """Fit on four rows in five of each class, set probabilities on the fifth for classes as frequent as ``share_good``.

    A class of two to four rows gives one to the latter. Without two rows of both classes every score
    is the share of good labels (one half without labels).
    """
    part = np.zeros(len(rows), bool)
    for own in (np.flatnonzero(good), np.flatnonzero(~good)):
        part[own[4::5] if len(own) > 4 else own[1:][-1:]] = True
    if min(good[~part].sum(), (~good[~part]).sum(), good[part].sum(), (~good[part]).sum()) == 0:
        share = min(max(share_good, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    fitted = [r for r, p in zip(rows, part) if not p]
    ratio = log_count_ratio(fitted, good[~part])
    weight, bias = fit_hinge(fitted, good[~part], ratio)
    model = Model(weight * ratio, ratio**2, bias, 1.0, 0.0)
    margins, y = np.array([model.margin(r) for r, p in zip(rows, part) if p]), good[part]
    importance = np.where(y, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    slope, shift = fit_logistic(margins, y, importance)
    return Model(model.weight, model.square, bias, slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[pd.DataFrame, float]:
    """(ids, good) of a bounded sample of labelled rows that are not held out, and the share of good labels.

    At most ``rows_per_class`` labels of each class, the same ones in every run; the sample's
    labels are few enough to broadcast, so ``docs`` are read but not moved.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (remainder(F.col("_id"), HELD_OUT_PARTS) != HELD_OUT_PART)
    )
    counts = dict(usable.groupBy("_y").count().collect())  # two rows at most
    sample = None
    for y in (0, 1):
        few = usable.where(F.col("_y") == y).orderBy(fraction_of(F.col("_id")), "_id").limit(rows_per_class)
        sample = few if sample is None else sample.union(few)
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [indicators(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["id", "y", "ids"])

    got = texts.join(F.broadcast(sample.distinct()), "_id").select("_id", "_y", "_text").mapInArrow(run, "id long, y int, ids array<int>").toPandas()
    got["ids"] = [np.asarray(x, np.int32) for x in got["ids"]]
    got["key"] = [int(x.sum()) for x in got["ids"]]
    got = got.sort_values(["id", "y", "key"], kind="stable").reset_index(drop=True)
    total = sum(counts.values())
    return got, counts.get(1, 0) / total if total else 0.5


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    rows, share = training_rows(docs, labels, rows_per_class)
    mixed = rows.sample(frac=1, random_state=0)
    return train(list(mixed["ids"]), mixed["y"].to_numpy() == 1, share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better), predicted.

    Only the whole text counts. A null or empty text has no indicators and the score of the bias.
    Repeated rows stay, equal texts score alike, a null doc_id counts as the empty id in
    ``held_out``; other columns are ignored, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(indicators(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT_PART).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [sent.value.score(indicators(t.as_py())) >= threshold for t in batch.column(place)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
