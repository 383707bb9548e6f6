"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1/-1 bits. Linear classifiers over hashed letter bigrams
and trigrams predict the bits, each fitted by logistic loss; a text gets the language whose
codeword has the smallest loss summed over its bits, each bit weighted by how well its classifier
does. Texts whose two best codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import bounded_batches, fraction_of, id_and_text, remainder

SIZE = 1 << 12
TRAINING_ROWS = 1600
LEAST_ROWS = 20
HELD_OUT_PARTS, HELD_OUT_PART = 4, 2
ROUNDS = 150
DECAY = 1e-4
AMBIGUOUS_GAP = 0.5
UNKNOWN = "und"
#: Letters, and number signs that are neither digits nor letters.
WORD_SIGN = re.compile(r"[^\W\d_]")
ROWS_AT_ONCE = 64


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(sign[0].isalpha() for sign in WORD_SIGN.finditer(text or ""))


def features(text: str | None) -> np.ndarray:
    """Unit-length vector of square roots of hashed n-gram counts of a whole text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    blank = codes == 32
    codes = np.r_[np.uint32(32), codes[~(blank & np.r_[True, blank[:-1]])], np.uint32(32)] if len(codes) else codes
    counts = np.zeros(SIZE)
    for n in (2, 3):
        if len(codes) >= n:
            mixed = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount(mixed & np.uint32(SIZE - 1), minlength=SIZE)
    root = np.sqrt(counts)
    return (root / (np.linalg.norm(root) or 1.0)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1/-1: all distinct splits for up to 5 languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        rows = np.array([[1 if b >> k & 1 else -1 for b in range(1, 1 << (n - 1))] for k in range(n - 1)])
        return np.vstack([-np.ones((1, rows.shape[1])), rows]).astype(float)
    rng, best, distance = np.random.default_rng(0), None, -1
    bits = 16 + int(np.ceil(6 * np.log2(n)))
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        apart = int(((bits - code @ code.T) / 2 + np.eye(n) * bits).min())
        if apart > distance and (abs(code.sum(axis=0)) < n).all():
            best, distance = code, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(rows, languages): weighted loss of every codeword."""
        margins = x @ self.weight + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(axis=2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, probability and ambiguity of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        loss = self.losses(np.array([features(t) for t in texts])) if texts else np.empty((0, 1))
        order = np.argsort(loss, axis=1, kind="stable")
        best = np.take_along_axis(loss, order[:, :1], 1)
        chance = 1 / np.exp(np.minimum(60, loss - best) * -1).sum(axis=1)
        gap = np.take_along_axis(loss, order[:, 1:2], 1) - best if len(self.languages) > 1 else np.full((len(texts), 1), np.inf)
        known = [has_letter(t) for t in texts]
        return (
            [self.languages[k] if ok else UNKNOWN for k, ok in zip(order[:, 0], known)],
            [float(c) if ok else 0.0 for c, ok in zip(chance, known)],
            [bool(g < AMBIGUOUS_GAP) or not ok for g, ok in zip(gap[:, 0], known)],
        )


def train(x: np.ndarray, labels: np.ndarray) -> Model:
    """One logistic classifier for each bit of the code, all by the same accelerated descent."""
    languages = sorted(set(labels.tolist()))
    code = codewords(len(languages))
    index = np.array([languages.index(v) for v in labels], int)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((SIZE, 0), np.float32), np.zeros(0), np.zeros(0))
    y = code[index]
    share = np.bincount(index, minlength=len(languages))[index]
    importance = (1 / share / len(languages))[:, None]
    weight, bias = np.zeros((SIZE, y.shape[1]), np.float32), np.zeros(y.shape[1])
    ahead, bias_ahead, rate = weight, bias, 20.0
    for k in range(ROUNDS):
        slope = -y * importance / (1 + np.exp(np.clip(y * (x @ ahead + bias_ahead), -30, 30)))
        new = (ahead - rate * (x.T @ slope.astype(np.float32) + DECAY * ahead)).astype(np.float32)
        new_bias = bias_ahead - rate * slope.sum(axis=0) * 0.1
        push = k / (k + 3)
        ahead, bias_ahead = new + np.float32(push) * (new - weight), new_bias + push * (new_bias - bias)
        weight, bias = new, new_bias
    right = ((x @ weight + bias) * y > 0).mean(axis=0)
    return Model(languages, code, weight, bias, np.maximum(right - 0.5, 0.01) * 2)


def fit(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Learn from a bounded sample of the rows with a lang that are not held out.

    About ``training_rows`` rows shared evenly between the languages, at least ``LEAST_ROWS`` of
    each, and never more than twice as many in all; the same rows in every run.
    """
    usable = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & (remainder(F.col("_id"), HELD_OUT_PARTS) != HELD_OUT_PART)
    )
    counts = usable.groupBy("_lang").agg(F.count("*").alias("_n"))
    share = training_rows / max(1, counts.count())
    rates = counts.select("_lang", (F.lit(max(LEAST_ROWS, share)) / F.col("_n")).alias("_rate"))
    chosen = usable.join(F.broadcast(rates), "_lang").where(fraction_of(F.col("_id")) < F.col("_rate"))
    sample = chosen.orderBy(fraction_of(F.col("_id")), "_id", "_lang", "_text").limit(2 * max(training_rows, LEAST_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["lang", "x"])

    rows = sample.select("_lang", "_text").mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(len(rows), SIZE)
    return train(x, np.array([r[0] for r in rows], object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Only the whole text counts. Null texts and texts without a letter are ``und`` with score 0;
    without any learned language all are. Equal texts get equal results, repeated rows stay, a null
    doc_id counts as the empty id in ``held_out``; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights for each bit of the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lang, score, unsure = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    found = id_and_text(docs).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )
    held = (remainder(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT_PART).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "ambiguous")
