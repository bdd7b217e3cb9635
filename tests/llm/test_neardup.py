import random
import re

import pytest

from tidemark.llm import neardup
from tidemark.llm.neardup import near_duplicates
from tidemark.plans.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_force(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(30)]
    rows = []
    for words in base:
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    hub = [word() for _ in range(150)]
    for _ in range(40):  # copies of one text, many of them further apart from each other than from it
        copy = list(hub)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += ["", None, " \t\n", "A b", "a B", "a b", rows[0].upper(), rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_brute_force(docs, k):
    rows = corpus()
    want = brute_force(rows, k, 80)
    got = near_duplicates(docs(rows), shingle=k, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_repeated_rows_and_empty(docs):
    got = near_duplicates(docs([(3, "x y z w v"), (3, "x y z w v"), (9, "x y z w v"), (4, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (3, 3), (4, 4), (9, 3)]
    assert near_duplicates(docs([])).collect() == []
    assert [r.component_id for r in near_duplicates(docs([(1, "")])).collect()] == [1]


def test_null_and_repeated_ids(docs):
    """Rows are told apart by themselves: texts under one id keep their own links, and null ids are documents."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(7, one), (7, two), (5, one + " x"), (9, two + " y"), (None, three), (None, three + " z"), (None, two), (3, "")] + [(8, two)] * 5
    got = near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (5, 5), (7, 5), (7, 7), *[(8, 7)] * 5, (9, 7)]
    none = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(none, key=str) == [(7, False), (None, False), (None, True)]
    assert sum(r.kept for r in got) == 4


@pytest.mark.parametrize("rare", [1, 8])
def test_large_groups(docs, rare, monkeypatch):
    """Groups of edited, of shortened, and of chained copies: every link counts, few pairs are looked at."""
    monkeypatch.setattr(neardup, "RARE", rare)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for kind in range(3):
        base = [word() for _ in range(100)]
        for k in range(90):
            copy = list(base)
            if kind == 0:
                for _ in range(rng.randint(0, 9)):
                    copy[rng.randrange(100)] = word()
            elif kind == 1:
                copy = copy[: rng.randint(40, 100)]
            else:
                copy[k] = base[k] = word()
            rows.append(" ".join(copy))
    rows.append(" ".join(word() for _ in range(30_000)))
    rows.append(rows[-1] + " end")
    rows = list(enumerate(rows))
    got = near_duplicates(docs(rows), shingle=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 4, 80)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_texts_built_from_the_same_passages(docs, monkeypatch):
    """300 documents of 38 out of 50 passages, all somewhat alike and none linked: few pairs are compared by their texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passages = [" ".join(word() for _ in range(14)) for _ in range(50)]
    rows = [(i, "\n".join(p for k, p in enumerate(passages) if k in picked)) for i, picked in enumerate(set(rng.sample(range(50), 38)) for _ in range(300))]
    rows += [(300, rows[0][1] + " end"), (301, rows[5][1].replace(passages[7], ""))]
    compared, real = [], neardup._with_both

    def counted(pairs, rows, most, texts, column):
        if column == "text":
            compared.append(pairs.count())
        return real(pairs, rows, most, texts, column)

    monkeypatch.setattr(neardup, "_with_both", counted)
    got = near_duplicates(docs(rows), shingle=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 4, 80)
    assert sum(compared) < 10 * len(rows)


def test_least_agreement():
    """The share of pairs of a similarity whose signatures agree less, by drawing them."""
    rng = random.Random(1)
    for j, loss in ((0.8, 0.01), (0.5, 0.1)):
        least = neardup.least_agreement(j, 256, loss)
        lost = sum(sum(rng.random() < j for _ in range(256)) < least for _ in range(3000)) / 3000
        assert lost <= 1.5 * loss and neardup.least_agreement(j, 256, 2 * loss) >= least
