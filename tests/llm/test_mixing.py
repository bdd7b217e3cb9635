import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Plain water filling."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = {i for i in free if unit * w[i] > cap * sizes[i]}
        for i in full or free:
            out[i] = cap * sizes[i] if full else unit * w[i]
        left -= sum(out[i] for i in full)
        free = free - full if full else set()
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 1000, 5], [], [0, 5], [0], [3 * k % 101 for k in range(300)]])
def test_targets(spark, sizes):
    names = [None if i == len(sizes) - 1 else f"{i:05d}" for i in range(len(sizes))]
    got = mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, n long")).collect()
    got.sort(key=lambda r: r.s)
    assert [(r.s, r.source) for r in got] == list(enumerate(names))
    assert [r.target for r in got] == pytest.approx(targets(sizes))


ROWS = [(i, " ".join(["w"] * (i * 37 % 900)), None, ["b", "a", None, "\U0001f600", "￿"][min(i % 9, 4)]) for i in range(200)] + [(200, None, None, "a"), (201, "", None, None), (5, "x y", None, "a"), (5, "x y", None, "a")]


@pytest.mark.parametrize("block", [7, 128])
def test_mix(docs, block):
    rows = mixing.mix(docs(ROWS), block=block).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    sizes, taken, target, said = Counter(), Counter(), {}, {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], said[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    assert said == dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(targets([sizes[s] for s in order]))
    for s in order:
        assert abs(taken[s] - target[s]) <= 5 * block
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, *_ in ROWS)
    again = mixing.mix(docs(ROWS), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_brute_force(spark, docs):
    """``taken`` by a plain loop: golden-ratio points one by one, blocks one by one, in the order of the documents' hashes."""
    block, rows = 16, [(i, "w " * (i * 37 % 90), None, "abc"[i % 3]) for i in range(120)]
    df = docs(rows)
    hashes = dict(df.select("doc_id", F.xxhash64(F.lit("cell"), "doc_id")).collect())
    size = {r[0]: r[1].count("w") for r in rows}
    names = sorted({r[3] for r in rows})
    cells = math.isqrt(len(rows))
    order = {s: sorted((i for i, _, _, x in rows if x == s and size[i]), key=lambda i: (hashes[i] % cells, hashes[i], i)) for s in names}
    line = {s: [i for i in order[s] for _ in range(size[i])] for s in names}
    target = targets([len(line[s]) for s in names])
    blocks = [-(-len(line[s]) // block) for s in names]
    need = [t // n * b + t % n / block for t, n, b in zip(target, map(len, line.values()), blocks)]
    rank, want = Counter(), Counter()
    for i in range(round(sum(need))):
        point, s = (i + 1) * 0x9E3779B97F4A7C15 % 2**64 / 2**64 * sum(need), 0
        while point >= need[s]:
            point, s = point - need[s], s + 1
        if rank[s] < 2 * blocks[s]:
            b = rank[s] % blocks[s]
            want.update(line[names[s]][b * block : (b + 1) * block])
        rank[s] += 1
    assert {r.doc_id: r.taken for r in mixing.mix(df, block=block).collect()} == {i: want[i] for i in size}


def test_the_sequence_decides(docs, monkeypatch):
    df = docs(ROWS)
    plain = Counter((r.doc_id, r.taken) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "_golden", lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([0.0] * b.num_rows)], names=["slot", "point"]) for b in batches))
    assert Counter((r.doc_id, r.taken) for r in mixing.mix(df).collect()) != plain


def test_schedule_is_even(spark):
    stretches = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 0.8), (2, 0.8, 1.0)], "s int, lo double, hi double")
    rows = mixing.schedule(stretches, 100).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(100))
    assert all(sorted(r.rank for r in rows if r.s == s) == list(range(sum(r.s == s for r in rows))) for s in range(3))
    for n in range(10, 101, 10):
        for s, w in enumerate((0.5, 0.3, 0.2)):
            assert abs(sum(r.s == s for r in rows[:n]) - w * n) <= 2


def test_documents(docs):
    df = docs(ROWS)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() > 0
    assert mixing.mix(docs([])).collect() == [] and mixing.mixed_documents(docs([])).collect() == []
    assert [r.taken for r in mixing.mix(docs([(1, None, None, "a")])).collect()] == [0]
