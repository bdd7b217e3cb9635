import hashlib
import re
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_neardup import brute_force
from tidemark.llm import bpe, langid, mixing
from tidemark.plans.lineage import new_table_path


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = new_table_path(spark, "stage")
        stage(spark, docs, tiny).write.parquet(path)
        out = spark.read.parquet(path)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= kept
        if k < 4:
            assert out.columns == columns, name
        docs, kept = out, ids
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup"


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert {"doc_id", "n_tokens"} <= set(out.columns) and out.count() > 0


def test_null_and_repeated_ids_are_documents(spark, docs, tiny):
    """Different texts stay, each once, whatever their ids; near copies go, whatever theirs."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1), "en", "a"), (None, text(2), "en", "a"), (7, text(3), "en", "a"), (7, text(4), "en", "b"), (8, text(5), "en", "b")]
    copies = [(7, text(1), "en", "b"), (9, text(4), "en", "b"), (8, text(5), "en", "b"), (None, text(2) + " more", "en", "a")]
    out = corpus_pipeline.dedup_stage(spark, docs(rows + copies), tiny)
    got = sorted(r.text.removesuffix(" more") for r in out.collect())
    assert got == [text(k) for k in range(1, 6)]


def test_mix_by_row(spark, docs, tiny):
    """Every row comes as often as its own share says: with one source all twice at a share of 2."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, text(1), "en", "a"), (None, text(2), "en", "a"), (7, text(3), "en", "a"), (7, text(4), "en", "a"), (8, text(5), "en", "a"), (8, text(5), "en", "a"), (None, None, "en", "a")]
    out = mixing.mixed_documents(docs(rows), share=2.0)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(2 * [r[:2] for r in rows if r[1]])


ODD = [(1, None, None, None), (2, "", "en", "a"), (None, None, "en", "b"), (3, " \n\t", None, "a"), (4, "word " * 30_000, "en", "a"), (5, "the cat sat", "en", "a"), (5, "the cat sat", "en", "a"), (6, "the cat sat", "en", "b")]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, docs, tiny, k):
    """Null and empty texts, null and repeated ids, a very long text, ties, clashing columns, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[k]
    clash = ("label", "score", "kept", "size", "key", "ids", "taken", "component_id", "__x", "__key", "__times", "__rows", "__copy", "row", "times", "rows")
    df = docs(ODD)
    for c in clash:
        df = df.withColumn(c, F.lit(c))
    df = df.withColumn("map", F.create_map(F.lit("k"), "doc_id")).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.lit("v")))))
    for rows in (df, df.limit(0)):
        path = new_table_path(spark, "odd")
        stage(spark, rows, tiny).write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == df.columns, name
            assert all(r[c] == c for r in out.collect() for c in clash)
            assert {(r.doc_id, r.text) for r in out.collect()} <= {r[:2] for r in ODD}
        else:
            assert out.count() == rows.count()
        if rows is not df:
            assert out.count() == 0
    kept = Counter((r.doc_id, r.text) for r in stage(spark, df, tiny).collect()) if k in (1, 2) else None
    if k == 1:
        assert not any(t is None or not t.strip() for _, t in kept)
    if k == 2:
        assert kept == Counter([r[:2] for r in ODD[:5]] + [(5, "the cat sat")]) or kept == Counter([r[:2] for r in ODD[:5]] + [(6, "the cat sat")])


def test_brute_force(spark, tiny):
    """What each stage makes of what the one before kept: groups by comparing all pairs, shares by hand, ids by the library."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = new_table_path(spark, "stage")
        stage(spark, seen[-1], tiny).write.parquet(path)
        seen.append(spark.read.parquet(path))
    _, good, known, unique, mixed, encoded = seen

    net = langid.train(good)
    least = langid.least_evidence(good, net)
    rows = {r.row.doc_id: r for r in langid.label(good, net, ("doc_id", "text")).collect()}

    def evidence(r):
        letters, shown = (sum(f(c) for c in r.row.text) for f in (lambda c: unicodedata.category(c)[0] in "LM", lambda c: c not in " \t\n\x0b\f\r"))
        return 1 / len(net.languages) + (r.score - 1 / len(net.languages)) * letters / max(shown, 1)

    assert {r.doc_id for r in known.collect()} == {i for i, r in rows.items() if r.lang_pred != "und" and evidence(r) >= least}

    texts = {r.doc_id: r.text for r in known.collect()}
    groups = brute_force(list(texts.items()), 5, 80)
    kept = [groups[r.doc_id][1] for r in unique.collect()]
    assert sorted(kept) == sorted({g for _, g in groups.values()})

    times = Counter(r.doc_id for r in mixed.collect())
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in unique.collect()}
    assert set(times) <= set(words) and max(times.values()) <= 2
    total = sum(words[i] * n for i, n in times.items())
    assert abs(total - 1.5 * sum(words.values())) < 0.1 * sum(words.values())

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, n in times.items():
        ids = library.encode_ordinary(texts[i])
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] = n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in encoded.collect()) == want
