"""Searches and negatives against brute force, with nulls, ties, copies and clashing names."""

from __future__ import annotations

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import blocks, lexical, negatives, topk
from tests.llm import cases

VECTORS = "vec_id long, embedding array<double>, label int, row string, shard int, score double"


def vector_rows(n=300, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.6, size=dim)).tolist(), int(rng.integers(0, 6))) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(60)]  # many equal vectors, so ties
    rows += [(20, rows[40][1], 2), (20, rows[40][1], 2), (40, rows[3][1], 1), (-20, rows[5][1], 0), (-700, rows[9][1], 4)]
    rows += [
        (400, None, 1), (420, [], 1), (440, [1.0, None] + [0.0] * (dim - 2), 1), (460, [float("nan")] * dim, 1), (480, [float("inf")] * dim, 1),
        (None, rows[0][1], 1), (500, [1.0, 2.0], 1), (520, [-3.0, 0.5], 2), (540, [0.0] * dim, None), (560, [1e200] * dim, 1), (700, [0.0] * dim, 1),
        (580, [1e5] * dim, 1), (600, [-1e5] * dim, 2), (700, rows[1][1], 3),
    ]
    return rows


def usable(rows, factor, labelled):
    for i, x, label in rows:
        if i is None or x is None or (labelled and label is None) or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [floor(c * factor) for c in x]
        if sum(c * c for c in v) <= blocks.LARGEST_SQUARE:
            yield i, v, label


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every):
    items, out = list(usable(rows, topk.FACTOR, False)), []
    for at, (i, v, _) in enumerate(items):
        if i % every == 0:
            others = sorted((-dot(v, w), j) for b, (j, w, _) in enumerate(items) if b != at and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_values", "levels"), [(blocks.SHARD_VALUES, topk.LEVELS), (700, 8)])
def test_top_k_against_brute_force(spark, shard_values, levels):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], VECTORS)
    got = topk.top_k(table, k=7, shard_values=shard_values, levels=levels)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 7, topk.EVERY)
    assert topk.top_k(table.limit(0)).collect() == []


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=8, size=(20_000, 32)).astype(np.int64)
    x[:40] = x[0] + rng.integers(-1, 2, size=(40, 32))
    index, ids = topk.Index(np.arange(len(x)), np.arange(len(x)), x), np.arange(len(x))
    processed = []
    for own in [*range(40), *range(1000, 1040)]:
        at, scores, postings = index.search(own, x[own], 20)
        exact = x @ x[own]
        exact[own] = exact.min() - 1
        assert at.tolist() == blocks.best(exact, ids, 20).tolist() and (scores == exact[at]).all()
        processed.append(postings / x.size)
    assert min(processed) < 0.7


def brute_negatives(rows, every, positives, n, low, high):
    items, out = list(usable(rows, negatives.FACTOR, True)), []
    for at, (i, v, label) in enumerate(items):
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, m, b) for b, (j, w, m) in enumerate(items) if b != at and len(w) == len(v)), key=lambda t: (t[0], t[1], t[3]))
        for ps, p, _, _ in [t for t in scored if t[2] == label][:positives]:
            found = [(j, -s) for s, j, m, _ in scored if m != label and low * -ps <= 100 * -s <= high * -ps]
            out += [(i, p, rank, j, -ps, s) for rank, (j, s) in enumerate(found[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_values", [blocks.SHARD_VALUES, 500])
def test_hard_negatives_against_brute_force(spark, shard_values):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], VECTORS)
    got = negatives.hard_negatives(table, every=20, shard_values=shard_values)
    expected = brute_negatives(rows, 20, negatives.POSITIVES, negatives.NEGATIVES, negatives.LOWEST, negatives.HIGHEST)
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 100
    assert negatives.hard_negatives(table.limit(0)).collect() == []
    assert negatives.hard_negatives(table.where("label is null")).collect() == []


def test_labels_move_on():
    assert negatives.window_of(101, 30, 90) == (31, 90) and negatives.window_of(0, 30, 90) == (0, 0)
    low, high = negatives.window_of(-10, 30, 90)
    assert low > high


def test_noisy_labels(spark):
    table = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)], "vec_id long, embedding array<double>, label int")
    assert [r.label for r in negatives.noisy_labels(table).orderBy("vec_id").collect()] == [0, 9, None]


@pytest.mark.parametrize(("dim", "scale"), [(64, 30), (200, 1000), (7, 1 << 25), (1, 1 << 28)])
def test_residue_products_are_exact(dim, scale):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-scale, scale + 1, size=(40, dim)) for _ in range(2))
    exact = a.astype(object) @ b.T.astype(object)
    primes = negatives.moduli(dim * scale * scale)
    got = negatives.product(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert (got == exact).all()
    assert all(p % 2 and all(p % d for d in range(3, int(p**0.5) + 1, 2)) for p in negatives.primes())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def brute_search(docs, items, k):
    counts = [Counter(WORD.findall((t or "").translate(FOLD))) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    out = []
    for item, text in items:
        asked = Counter(WORD.findall((text or "").translate(FOLD)))
        found = []
        for (doc_id, _), c, n in zip(docs, counts, lengths):
            m = 25 + 75 * n * n_docs // max(1, n_terms)
            score = sum(
                times * floor(1000 * log((2 * n_docs + 2) / (2 * sum(t in d for d in counts) + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 20_000])
def test_lexical_search_against_brute_force(spark, block_bytes):
    docs = cases.documents(spark, n=90)
    texts = [r.text for r in docs.select("text").collect()]
    items = [(i, " ".join((texts[i * 3] or "").split()[:25])) for i in range(20)] + [
        (20, None), (21, ""), (22, "!?"), (23, "unknown words only"), (24, "word word WORD w1 W1"), (25, "élan ÉLAN straße don't"), (None, "w2 w3"), (3, "w4"), (3, "w4"),
    ]
    given = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("terms"), F.lit(3).alias("doc_id"))
    got = lexical.search(docs, given, k=6, block_bytes=block_bytes).collect()
    expected = brute_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items, 6)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_lexical_search_of_nothing(spark):
    docs, items = cases.documents(spark), spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical.search(cases.no_documents(spark), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).collect() == []
    assert lexical.search(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items).collect() == []


def test_node_bounds_prune_whole_batches():
    rng = np.random.default_rng(5)
    n, terms = 4096, 400
    topic = rng.integers(0, 40, n)
    doc = np.repeat(np.arange(n), 8)
    term = topic[doc] * 10 + rng.integers(0, 10, len(doc))
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    docs = lexical.Documents(np.arange(n), np.zeros(n, np.int64), doc, term, rng.integers(1, 1000, len(doc)))
    item = np.repeat(np.arange(30), 5)
    asked = np.concatenate([t * 10 + rng.choice(10, 5, replace=False) for t in range(30)])
    items = lexical.Items(np.arange(30), item, asked, np.ones(150, np.int64), np.ones(terms, np.int64), np.zeros(30, np.int64), 10)
    scored, pairs = lexical.walk(items, docs)
    assert scored < pairs / 5


def test_registered_searches(spark, tmp_path):
    from sensorloom.llm.queries import ORACLES, QUERIES

    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name in ("op11_topk", "op12_lexical_search", "op13_hard_negatives"):
        got = QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        sql = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(sql)
