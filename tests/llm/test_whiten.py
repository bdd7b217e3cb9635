import math
import random

import numpy as np
import pytest

from tidemark.llm.queries import QUERIES
from tidemark.llm.whiten import whiten

SHAPE = "vec_id long, embedding array<double>, n string, component string"


def brute_force(rows, most=16):
    """Rows (vec_id, vector) as plain Python and numpy see them: x vectors, deviation, eigenvalues, projections."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in good)
    good = [(i, tuple(x + [1_000_000] * (d - len(x)))) for i, x in good]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    e, q, trace = values[order], vectors[:, order], values.sum()
    out = {}
    for i, x in good:
        apart = [n * c - s for c, s in zip(x, sums)]
        out.setdefault(i, []).append((sum(a * a for a in apart), (np.array([a / n for a in apart]) @ q) / np.sqrt(np.maximum(e, 1e-300))))
    return n, e / trace, out


def check(got, rows, most=16):
    n, share, want = brute_force(rows, most)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert sorted(by, key=str) == sorted(((i, k) for i in want for k in range(1, len(share) + 1)), key=str)
    signs = {}
    for (i, k), found in by.items():
        assert len(found) == len(want[i]) and {r.n for r in found} == {n}
        assert sorted(r.deviation for r in found) == sorted(dev for dev, _ in want[i])
        assert all(abs(r.explained - share[k - 1]) <= 1e-9 for r in found)
        for r, (_, y) in zip(sorted(found, key=lambda r: r.deviation), sorted(want[i], key=lambda w: w[0])):
            if abs(y[k - 1]) > 1e-6:
                signs.setdefault(k, set()).add(r.whitened * y[k - 1] > 0)
            assert math.isclose(abs(r.whitened), abs(y[k - 1]), rel_tol=1e-7, abs_tol=1e-9)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("tile", [64, 4])
def test_brute_force(spark, tile):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(k, 0.1 + 0.2 * k) for k in range(10)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (None, rows[1][1]), (7, rows[2][1]), (400, None), (401, [1.0, None] + [0.0] * 8), (402, [float("nan")] * 10), (403, [float("-inf")] * 10), (404, [0.5, 0.5])]
    got = whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SHAPE), most=6, tile=tile).collect()
    check(got, rows, 6)


def test_few_dimensions_and_many_copies(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(200)]
    check(whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SHAPE)).collect(), rows)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SHAPE)
    assert whiten(make([])).collect() == []
    assert whiten(make([(1, None), (2, [float("nan")])])).collect() == []
    assert whiten(make([(1, [])])).collect() == []
    one = whiten(make([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()  # a single vector has no variance
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, k, 1, 0, None, 0.0, 0.0) for i in (1, 2) for k in (1, 2)}
    flat = whiten(make([(i, [float(i), 3.0]) for i in range(5)])).collect()  # one dimension has no variance
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {round(r.explained, 9) for r in flat} == {0.0, 1.0}
    wide = whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(wide) == 6 and all(r.deviation is None for r in wide if r.vec_id != 3) and max(r.explained for r in wide) > 0.99


def test_query(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    check(QUERIES["op12_embedding_whitening"](spark, tiny).collect(), rows)
