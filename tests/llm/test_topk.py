import math
import random

import numpy as np
import pytest

from tests.compare import assert_same
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.topk import kth_best, top_k


def brute_force(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 2e5])
def test_brute_force(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, scale) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (600, [float("inf")] * 8), (700, [0.0] * 8)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = top_k(df, k=10, every=100, batch=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_force(rows, 10, 100)


def test_repeated_ids_and_batches(spark):
    """Rows that repeat an id are candidates each, and a sample of one id has pivots all the same."""
    rows = [(7, [float(k % 5), 1.0]) for k in range(40_000)] + [(0, [1.0, 0.5]), (100, [2.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=100, batch=1).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score // 1024) for r in got} == {(0, k, 7, 4608) for k in (1, 2, 3)} | {(100, k, 7, 8192) for k in (1, 2, 3)}


def test_kth_best():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-9, 9, (300, 4)), rng.integers(-9, 9, (50, 4))
    got = kth_best(np.arange(300), q, np.arange(50), x, 5)
    for k in range(300):
        assert got[k] == sorted((int(q[k] @ x[j]) for j in range(50) if j != k), reverse=True)[4]
    assert (kth_best(np.arange(3), q[:3], np.arange(2), x[:2], 5) == -(1 << 63)).all()


def test_few(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top_k(make([])).collect() == []
    assert top_k(make([(0, [1.0])])).collect() == []
    assert [tuple(r) for r in top_k(make([(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_query(spark, tiny):
    assert_same(QUERIES["op9_exact_top_k"](spark, tiny), ORACLES["op9_exact_top_k"], tiny)
