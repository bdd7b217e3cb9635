import hashlib
import random
import re
import zlib

import pytest

from tests.compare import assert_same
from tidemark.llm import trie
from tidemark.llm.queries import ORACLES, QUERIES

SHAPE = "conv_id long, turn long, role string, text string, key string, depth string"


def brute_force(rows):
    """The nodes of (conv_id, turn, role, text) rows, from the definition."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, _digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(int(c / 20) * 20, [])[:h] + turns[h:])  # the remainder of SQL, which has the sign of c
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {k: sum(len(o) == len(k) + 1 and o[: len(k)] == k for o in nodes) for k in nodes}
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, members in nodes.items():
        below = [o for o in nodes if o[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], sum(children[o] == 0 for o in below), sum((len(nodes[o]) - 1) * words(o) for o in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[: trie.DIGEST]


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_brute_force(spark, partitions):
    """With few and with many partitions: with 40, most stacks are stitched."""
    rng = random.Random(partitions)
    rows = []
    for c in range(-25, 130):
        for t in range(rng.choice((1, 2, 3, 4, 7))):
            rows.append((c, t, rng.choice("ab"), rng.choice(("", "x", "x y", "x  y z"))))
    rows += [(300, None, None, None), (300, None, "a", "x y"), (300, 1, "a", "x"), (301, 1, "a", "x"), (301, 1, "a", "x"), (None, 0, "a", "x")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(trie.conversation_trie(table(spark, rows))) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies(spark):
    """A third of all conversations are one; their ids fill several blocks, and negative ones sort by number."""
    rows = [(c, t, "u", f"copy {t}") for c in range(-3000, 6000) for t in (0, 1)] + [(c, t, "u", f"own {c} {t}") for c in range(20_000, 20_300) for t in (0, 1, 2)]
    assert found(trie.prefix_trie(trie.turn_arrays(table(spark, rows)))) == sorted(_plain(rows), key=str)


def _plain(rows):
    convs = {}
    for c, _, _, text in rows:
        convs.setdefault(c, []).append(text)
    nodes = {}
    for c, texts in convs.items():
        for d in range(len(texts) + 1):
            nodes.setdefault(tuple(texts[:d]), []).append(c)
    at = {}
    for k in nodes:
        at.setdefault(k[:-1], []).append(k) if k else None
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * (len(k[-1].split()) if k else 0)
        leaves[k] = sum(leaves[c] for c in at.get(k, [])) or 1
        saved[k] = own + sum(saved[c] for c in at.get(k, []))
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        yield (min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(at.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())


def test_odd_tables(spark):
    assert found(trie.conversation_trie(table(spark, []))) == []
    assert found(trie.conversation_trie(table(spark, [(None, 1, "a", "x")]))) == []
    lone = [(c, 0, None, None) for c in range(21, 40)]  # no leader: turnless where h > 0
    assert found(trie.conversation_trie(table(spark, lone))) == brute_force(lone)
    long = [(c, t, "u", "w " * 3000 if t == 150 else str(t)) for c in (1, 2) for t in range(300)]
    assert found(trie.conversation_trie(table(spark, long))) == brute_force(long)


def test_common():
    a, b, c = (x * trie.DIGEST for x in "abc")
    assert [trie.common(a + b + c, x) for x in ("", a, a + b, a + c, b, a + b + c + a)] == [0, 1, 2, 1, 0, 3]


def test_query(spark, tiny):
    assert_same(QUERIES["op13_conversation_trie"](spark, tiny), ORACLES["op13_conversation_trie"], tiny)
