from __future__ import annotations

import numpy as np
import pytest

from sensorloom.llm import embeddings
from sensorloom.llm.components import smallest_labels


def brute(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    return near.sum(axis=1), smallest_labels(a, b, len(x))


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres + rng.normal(scale=s, size=centres.shape) for s in (0, 0.1, 0.2, 0.25)] + [centres[:1] + rng.normal(scale=0.05, size=(80, 24))])
    links, component = brute(x, embeddings.THRESHOLD)
    table = spark.createDataFrame([(i, v.tolist(), i % 3, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, pivot int")
    got = embeddings.near_duplicates(table, block=block).toPandas().sort_values("vec_id")
    assert got.n_links.sum() >= 0.9 * links.sum() and (got.n_links.to_numpy() <= links).all()
    assert (got.component_id.to_numpy() == component).mean() >= 0.9
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_very_long_and_very_short_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [2.0, 2.0]), (4, [1e308, -1e308]), (5, [5e-324, -5e-324]), (6, [1e200, -1e-200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_edge_cases(spark):
    a, b = [1.0, 2.0, 0.0], [0.0, -1.0, 3.0]
    rows = [
        (1, a), (2, a), (2, a), (3, [2.0, 4.0, 0.0]), (4, b), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 2.0]), (9, [1.0, float("nan"), 0.0]),
        (10, [float("inf"), 0.0, 0.0]), (None, a), (11, [1.0, 2.0]), (12, [1.0, 2.0]), (13, [-0.0, -1.0, 3.0]),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, links string")
    got = {}
    for r in embeddings.near_duplicates(table).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[3] == [(3, 1, False)]
    assert got[4] == [(1, 4, True)] and got[13] == [(1, 4, False)] and got[11] == [(1, 11, True)] and got[12] == [(1, 11, False)]
    for i in (5, 6, 7, 8, 9, 10):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, False)]
    assert embeddings.near_duplicates(table.limit(0)).collect() == []
