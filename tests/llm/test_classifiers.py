import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid, quality, words

VOICES = {"aa": "kalo mira sentu", "bb": "zchwü öpfen strag", "cc": "ñanda quillo vera"}


def sentence(rng, lang):
    parts = VOICES[lang].replace(" ", "")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 40)))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(i, sentence(rng, lang), lang, "s") for i in range(400) for lang in [rng.choice(list(VOICES))]]


def test_languages(docs, labelled):
    odd = [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 !! 34", "bb", "s"), (1003, "x" * 200_000, None, "s"), (7, labelled[7][1], "cc", "s")]
    rows = langid.identify(docs(labelled + odd)).collect()
    assert len(rows) == len(labelled) + len(odd)
    lang = {i: name for i, _, name, _ in labelled}
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 50 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_without_labels(docs):
    assert [r.lang_pred for r in langid.identify(docs([(1, "abc", None, None)])).collect()] == ["und"]
    assert langid.identify(docs([])).collect() == []


def test_labels_are_not_inputs(docs, labelled):
    """Held-out labels change nothing, and neither do source or n_chars of a row."""
    a = langid.identify(docs(labelled)).orderBy("doc_id").collect()
    changed = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang, _ in labelled]
    assert a == langid.identify(docs(changed)).orderBy("doc_id").collect()


def test_sparse_labels(spark, monkeypatch):
    """The sample is as large among many rows without a label as it would be without them."""
    rows = spark.range(40_000).selectExpr("id AS doc_id", "case when id % 40 = 0 then 'aa' end AS lang", "'w' || cast(id as string) AS text")
    seen = []
    monkeypatch.setattr(langid, "train_network", lambda samples, languages: seen.append(samples))
    langid.train(rows, sample_docs=100)
    langid.train(rows.where("lang is not null"), sample_docs=100)
    assert len(seen[0]) == 100 and seen[0] == seen[1]


def test_long_words_are_learnt_whole(docs, monkeypatch):
    word, seen = "ab" * langid.PIECE + "end", []
    monkeypatch.setattr(langid, "train_network", lambda samples, languages: seen.extend(samples))
    langid.train(docs([(i, word, "aa", "s") for i in range(8)]))
    assert {s[0].decode() for s in seen} == {word[i : i + langid.PIECE] for i in range(0, len(word), langid.PIECE)}


@pytest.mark.parametrize("n", [400, 6000])
def test_junk_is_not_identified(docs, n):
    """Signs with a letter or two go by the margin (400); with held-out rows to learn from (6000), mixed languages go too. Clean ones stay."""
    rng = random.Random(4)
    clean = [(i, sentence(rng, lang), lang, "s") for i in range(n) for lang in [rng.choice(list(VOICES))]]
    mixed = [" ".join(rng.sample([w for v in VOICES for w in sentence(rng, v).split()[:10]], 30)) for _ in range(5)]
    signs = ["12 !! 34 " * 40 + "a", "%%% *** " * 50 + "x y", "0x1 0x2 " * 3 + "99 " * 90]
    df = docs(clean + [(10_000 + i, t, None, "s") for i, t in enumerate(signs + (mixed if n == 6000 else []))])
    kept = [r.doc_id for r in langid.keep_identified(df).select("doc_id").collect()]
    assert not [i for i in kept if i >= 10_000]
    assert len(kept) >= 0.995 * n


def test_least_evidence_counts_all_rows(spark, monkeypatch):
    """More held-out rows than any sample held: the threshold is their quantile, to a step."""
    rows = spark.range(48_000).selectExpr("id AS doc_id", "'aa' AS lang", "translate(cast(id AS string), '0123456789', 'abcdefghij') AS text")
    score = lambda text: 0.7 + 0.3 * zlib.crc32(text.encode()) / 2**32
    monkeypatch.setattr(langid, "label", lambda docs, net, keep: docs.selectExpr("struct(lang, text) AS row", "lang AS lang_pred", "0.7 + 0.3 * crc32(text) / 4294967296D AS score"))
    net = langid.Network(None, None, None, None, ["aa", "bb"])
    e = sorted(score(str(i).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(48_000) if zlib.crc32(str(i).encode()) % 4 == 2)
    low = langid.least_evidence(rows, net)
    assert len(e) > 10_000 and low == int(e[-(-len(e) // 1000) - 1] * langid.STEPS) / langid.STEPS
    assert sum(x < low for x in e) <= len(e) * langid.LOST


def test_gradients():
    """Backpropagation through time agrees with finite differences."""
    rng = np.random.default_rng(0)
    d = langid.Direction(rng.normal(0, 0.5, (256, 3 * langid.HIDDEN)), rng.normal(0, 0.5, (langid.HIDDEN, 3 * langid.HIDDEN)), rng.normal(0, 0.5, 3 * langid.HIDDEN))
    x, up = rng.integers(0, 5, (4, 3)), rng.normal(0, 1, (4, 3, langid.HIDDEN))
    loss = lambda: float((d.run(x)[0] * up).sum())
    grads = d.back(x, d.run(x)[1], up)
    for p, g in zip((d.table, d.hidden, d.bias), grads):
        for _ in range(5):
            at = tuple(rng.integers(0, 5 if p is d.table and k == 0 else n) for k, n in enumerate(p.shape))
            old, e = p[at], 1e-2
            p[at] = old + e
            high = loss()
            p[at] = old - e
            low = loss()
            p[at] = old
            assert abs((high - low) / (2 * e) - g[at]) < 2e-2 * max(1, abs(g[at]))


def junk(rng):
    return rng.choice([" ".join(["spam"] * 60), " ".join(w.upper() + "!!" for w in sentence(rng, "aa").split()), " ".join(w + "***" for w in sentence(rng, "bb").split())])


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(2)
    return [(i, junk(rng) if bad else sentence(rng, "aa"), "aa", "s", int(not bad)) for i in range(500) for bad in [rng.random() < 0.3]]


def test_quality(spark, docs, graded):
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in graded] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs([r[:4] for r in graded] + [(900, None), (901, ""), (902, "y " * 100_000), (5, graded[5][1])])
    rows = quality.classify(df, labels).collect()
    assert len(rows) == 504
    truth = {r[0]: r[4] for r in graded}
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs([(1, "a b")]), none).collect()] == [0.5]
    assert quality.classify(docs([]), none).collect() == []


def test_sum_of_squares_identity():
    rng = np.random.default_rng(4)
    size = quality.WORDS + len(quality.STATISTICS) * quality.BINS
    m = quality.FactorisationMachine(0.3, rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 0.3, (size, quality.FACTORS)).astype(np.float32), np.zeros((len(quality.STATISTICS), quality.BINS - 1), np.float32))
    ix, stats = rng.integers(0, quality.WORDS, 6), rng.normal(0, 1, (1, len(quality.STATISTICS))).astype(np.float32)
    bins = m.features(stats)[0]
    feats = [(i, 1 / 6) for i in ix] + [(i, 1.0) for i in bins]
    z = m.bias + sum(m.linear[i] * x for i, x in feats)
    z += sum(float(m.factors[i] @ m.factors[j]) * x * y for a, (i, x) in enumerate(feats) for j, y in feats[a + 1 :])
    assert m.score(ix, np.array([6]), stats)[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_language_scores_by_a_plain_loop(docs, labelled):
    """The query's rows, byte by byte: every word forwards and backwards, labels at each position, means over the document."""
    texts = labelled[:12] + [(500, "kalo  zchwü\tñandañanda" * 3 + " 7", None, "s")]
    net = langid.train(docs(labelled))
    n = langid.HIDDEN

    def states(d, data):
        h, out = np.zeros(n), []
        for byte in data:
            a, b = d.table[byte].astype(float), h @ d.hidden + d.bias
            gates = 1 / (1 + np.exp(-(a[: 2 * n] + b[: 2 * n])))
            z, r = gates[:n], gates[n:]
            h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
            out.append(h)
        return out

    got = {r.row.doc_id: r for r in langid.label(docs(texts), net).collect()}
    for i, text, *_ in texts:
        total = np.zeros(len(net.languages))
        for word in text.encode().split():
            for at in range(0, len(word), langid.PIECE):
                piece = word[at : at + langid.PIECE]
                for f, b in zip(states(net.forward, piece), reversed(states(net.backward, piece[::-1]))):
                    e = np.exp(np.concatenate((f, b)) @ net.out + net.out_bias)
                    total += e / e.sum()
        total /= total.sum()
        assert got[i].lang_pred == net.languages[int(total.argmax())]
        assert got[i].score == pytest.approx(total.max(), abs=1e-3)


def test_quality_scores_by_a_plain_loop(spark, docs, graded):
    """The query's scores, pair by pair: every two features of a document."""
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in graded], "doc_id long, quality int, toxic int")
    df = docs([r[:4] for r in graded])
    m = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.classify(df, labels).where("doc_id < 8").collect()}
    for i, text, *_ in graded[:8]:
        w = words.split(*words.utf8(pa.array([text])))
        bins = m.features(quality.statistics(w, np.array([len(text)])))[0]
        feats = [(k, 1 / len(w.hashes)) for k in quality._hashed(w)] + [(k, 1.0) for k in bins]
        z = m.bias + sum(float(m.linear[k]) * x for k, x in feats)
        z += sum(float(m.factors[k] @ m.factors[j]) * x * y for a, (k, x) in enumerate(feats) for j, y in feats[a + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3)
