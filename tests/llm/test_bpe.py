import hashlib
import random
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None,
    "",
    "a",
    "  \n\n  x 　y  ",
    "I'll don't 'S 12345 ½ ²",
    "ab" * 3000,
    "$" * 2000 + " é\U0001f600\U0001f600",
    "\x1c\x85 t<|endoftext|>",
    "the cat sat on the mat\n" * 50,
    "Éèau queeuxier ë" * 20,
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_like_the_library(docs, reference):
    df = docs([(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (4, TEXTS[4])])
    rows = bpe.encode_digests(df, PATH, PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(docs, reference):
    rows = bpe.encode(docs(list(enumerate(TEXTS))), PATH, PATTERN).withColumn("back", bpe.decode(F.col("ids"), PATH)).collect()
    for r in rows:
        assert list(r.ids) == reference.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.back).decode() == (TEXTS[r.doc_id] or "")


def test_empty_table(docs):
    assert bpe.encode_digests(docs([]), PATH, PATTERN).collect() == []


@given(st.binary(min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_heap_merges(data):
    ranks = bpe.load_ranks(PATH)
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge_long(data, ranks) == [ranks[p] for p in parts]


def test_ranks_are_not_in_the_plan(docs):
    """Digits of the rank map in the plan are megabytes of the driver's memory; its arrays stay out of the rows too."""
    plan = bpe.encode_digests(docs([(1, "a b")]), PATH, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 50_000
    assert sum("MapInArrow" in line for line in plan.splitlines()) == 2 and not [line for line in plan.splitlines() if " AS __slots" in line]


def test_folds_look_up_two_pairs_a_merge(docs):
    """The ranks of the other pairs are kept: a lookup of every pair at every merge is quadratic."""
    text = bpe.fold_merges(F.col("piece"), F.col("meet"), F.col("shift"), F.col("slots"))._jc.toString()
    assert text.count("slots") == 2 and text.count("transform(") == 2  # these go over the piece once before the merges, and once after


def test_folds_merge_like_the_heap(spark):
    rng = random.Random(3)
    pieces = [b"a", b"\xff", b"a" * bpe.LONG, b"ab" * (bpe.LONG // 2), b" the" * 100] + [bytes(rng.choices(b"aeinst r\xc3\xa9", k=k)) for k in range(2, 512, 17)]
    rows = spark.createDataFrame([(bytearray(p), list(p)) for p in pieces], "piece binary, bytes array<int>")
    ranks = bpe.load_ranks(PATH)
    for r in bpe.with_folds(rows, "ids", PATH, lambda fold: fold(F.col("bytes"))).collect():
        assert r.ids == bpe.merge_long(bytes(r.piece), ranks)


def test_a_worker_holds_one_table(monkeypatch):
    """It grows from the frequent pieces and is made of them anew when it is too long."""
    monkeypatch.setattr(bpe, "TABLE", 5)
    ranks, known, sink = bpe.load_ranks(PATH), [b"a", b" the"], pa.BufferOutputStream()
    table = pa.table({"piece": pa.array(known), "ids": pa.array([[ranks[p]] for p in known], pa.list_(pa.int32()))})
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    frequent, rows = SimpleNamespace(value=sink.getvalue().to_pybytes()), [["a", "xq", "zzq"], [], [" the", "xq"], ["qa", "qb", "qc"], ["xq", "a" * 600, "a"]]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([r], pa.list_(pa.string()))], names=["key", "pieces"]) for k, r in enumerate(rows)]
    found, run = [], bpe._index(frequent)(iter(batches))
    for b in run:
        assert sum(isinstance(v, dict) for v in run.gi_frame.f_locals.values()) == 1
        folded = [[[] if len(p) > bpe.LONG else bpe.merge_long(bytes(p), ranks) for p in new] for new in b.column(3).to_pylist()]
        found.append(b.set_column(3, "new", pa.array(folded, pa.list_(pa.list_(pa.int32())))))
    assert [b.column(2)[0].as_py() for b in found] == [2, 4, 4, 4, 2]
    got = [i for b in bpe._ids(PATH, frequent)(iter(found)) for i in b.column(1).to_pylist()]
    assert got == [[i for p in r for i in bpe.merge_long(p.encode(), ranks)] for r in rows]
