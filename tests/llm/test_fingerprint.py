import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as fp


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


ROWS = [(i * 97, words(i, 5 * i % 300)) for i in range(120)] + [(10**12, "é\U0001f600 x"), (-5, None), (3, ""), (4, "a"), (5, "z" * 5000)]


def test_edited_texts(docs):
    got = {r.doc_id: r for r in fp.fingerprints(docs(ROWS)).collect()}
    texts = {i: t or "" for i, t in ROWS}
    order = sorted(texts, reverse=True)
    assert len(got) == len(ROWS)
    for a, b in zip(order, order[1:] + order[:1]):
        n, half = len(texts[a]), len(texts[a]) // 2
        edited = texts[a][: n - half] + texts[b][:half]
        assert got[a].n_chars == n and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
        if edited == texts[a]:
            assert got[a].fingerprint == got[a].edited_fingerprint and got[a].near_edited == 1


def signature(spark, *texts):
    df = fp.with_signature(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", "s")
    return [r.s for r in df.orderBy("i").collect()]


def test_order_and_occurrences(spark):
    a = words(1, 200).split()
    swapped = a[100:] + a[:100]
    base, same, moved, other, double = signature(spark, " ".join(a), "  ".join(a), " ".join(swapped), words(2, 200), " ".join(a + a))
    near = lambda x, y: (len(set(x) & set(y)) / max(len(x), len(y))) ** 0.5
    assert base == same and near(base, other) == 0
    assert 0.5 < near(base, moved) < 1  # the same k-mers but two, in another order
    assert near(base, double) < 1


def test_scripts_without_spaces(spark):
    """A character more at the start leaves most of the text's tuples alone."""
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))
    base, more, other = signature(spark, text, "x" + text, text[::-1])
    near = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y))
    assert near(base, more) > 0.9 and near(base, other) < 0.1


def test_against_python(spark):
    """Numbering, bins, text order and tuples, step by step."""
    text = words(3, 60) + " a b c a b c a b c a b c"
    tokens = text.split()
    mers = spark.createDataFrame([(i, *tokens[i : i + 3]) for i in range(len(tokens) - 2)], "i long, a string, b string, c string").select("i", F.xxhash64("a", "b", "c").alias("h")).orderBy("i").collect()
    seen, numbered = {}, []
    for r in mers:
        h = r.h >> 24
        nth = seen.get(h, 0)
        seen[h] = nth + 1
        numbered.append((h, nth, r.i))
    hashed = spark.createDataFrame(numbered, "h long, nth int, i long").select("i", "h", "nth", F.xxhash64("h", "nth").alias("x")).orderBy("i").collect()
    rows = sorted((((r.x >> 24) if r.nth else r.h), r.i) for r in hashed)
    bins = {}
    for h, i in rows:
        bins.setdefault(h >> (64 - fp.BIN_BITS - 24), []).append((i, h & ((1 << fp._HASH_BITS) - 1)))
    tuples = [(b, *[h for _, h in sorted(v[: fp.KEEP])]) for b, v in sorted(bins.items())]
    tuples = [t + (-1,) * (1 + fp.KEEP - len(t)) for t in tuples]
    want = spark.createDataFrame(tuples, "b long, x long, y long").select(F.xxhash64("b", "x", "y").alias("s")).collect()
    assert sorted(signature(spark, text)[0]) == sorted(r.s for r in want)


@pytest.mark.parametrize("bits", [2, 12])
def test_following(spark, bits):
    ids = sorted({random.Random(i).randrange(-(10**5), 10**5) for i in range(80)}, reverse=True)
    got = {r.b: r.next for r in fp.following(spark.createDataFrame([(i,) for i in ids], "b long"), bits).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_small_tables(docs):
    assert fp.fingerprints(docs([])).collect() == []
    r = fp.fingerprints(docs([(1, "a b c d")])).collect()[0]
    assert r.near_next == 1 and r.n_chars == 7
    assert fp.fingerprints(docs([(1, "same"), (1, "same"), (None, "x"), (None, None)])).count() == 4
