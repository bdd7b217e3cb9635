"""The prefix trie of conversations, from sorted turn arrays and their longest common prefixes.

Each conversation becomes one text: the digests of its turns, end to end, so that texts sort as
their arrays of turns do and a common prefix of turns is a common prefix of the text. Equal
conversations are one row from then on. The rows are sorted over all partitions; a task sweeps
its part with a stack of open nodes, one for each turn of the row at hand. The longest common
prefix (LCP) of two neighbours says how far the stack goes down: what is popped is a finished
node, and hands its sums to the node below.

At the edge of a partition nodes stay open. Only the LCP of a partition's first row with the
last row before it, and of its last row with the next, is needed to tell which: two numbers a
partition. Open nodes come out as parts, a stack's worth for each edge, and parts of a node are
added up afterwards. A node's parent is known where both are popped together; other parents (one
for each different conversation) come by a join on the node's digest.

The ids of conversations that end in a node are hashed as one text. They are gathered in blocks of
``BLOCK`` numbers, and the blocks of a node pass through one hash, block after block: SHA-256 can't
be split, but no task holds more than a block.

Defined results: rows without a conv_id take no part; null roles and texts are empty. Turns go by
number, null first, those that share one by their digest (128 bits of SHA-256 over role and text);
rows that repeat are turns each. Extra columns are ignored. An empty table gives no node, not even
a root. A conversation's digests, 32 bytes a turn, are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.lineage import cut

#: Letters of a turn's digest.
DIGEST = 32
#: As a power of two: numbers in a block of ids.
BLOCK = 12
_EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "node string, parent string, open boolean, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SCHEMA = pa.schema(
    [("node", pa.string()), ("parent", pa.string()), ("open", pa.bool_()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(d, w)``, digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("d"), words.alias("w"))
    placed = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "d", "w")))
    return rows.groupBy("conv_id").agg(F.transform(placed, lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def with_shared_heads(arrays: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns come from the one ``c - c % every`` (the remainder has the sign of c); h is a hash of the id c, ``most`` at most."""
    leader = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = arrays.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("leader"), F.slice("turns", 1, most).alias("head"))
    head = F.slice(F.coalesce(F.col("head"), F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    return arrays.withColumn("leader", leader).withColumn("h", h).join(heads, "leader", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's blocks of ids, which come in order."""
    node, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for kid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if kid != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = kid, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["kid", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["kid", "ends"])


def ends_of(sequences: DataFrame) -> DataFrame:
    """``kid, ends``: for each ``kid`` the hash of its conversations' ids, in rising order with commas between."""
    block = F.shiftright("conv_id", BLOCK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = sequences.groupBy("kid", block.alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("kid").sortWithinPartitions("kid", "block").select("kid", "ids").mapInArrow(_end_hashes, "kid string, ends string")


def common(a: str, b: str) -> int:
    """How many turns two keys begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    lo, hi = 0, n
    while lo < hi:  # the longest prefix that is equal
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * DIGEST] == b[: mid * DIGEST] else (lo, mid - 1)
    return lo


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition in order, the LCP of its first key with the last one before; -1 for the first."""
    last = None
    for batch in batches:
        lcp = []
        for lo, hi in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lcp.append(-1 if last is None else common(last, lo))
            last = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lcp, pa.int32())], names=["p", "lcp"])


def _name(key: str, depth: int) -> str:
    return hashlib.blake2b(key[: depth * DIGEST].encode(), digest_size=16).hexdigest()


class _Node:
    """An open node: what the conversations seen so far add to it."""

    __slots__ = ("started", "n", "first", "children", "leaves", "saved", "ends")

    def __init__(self, started: bool):
        self.started, self.n, self.first, self.children, self.leaves, self.saved, self.ends = started, 0, None, 0, 0, 0, None


class Sweep:
    """The nodes of one partition's sorted keys, given the LCPs over its two edges (-1 where there is no neighbour)."""

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after
        self._right = -1  # nodes this deep reach over the last edge
        self.stack: list[_Node] = []
        self.key, self.words = "", []
        self.out: list[tuple] = []

    def add(self, key: str, words: list[int], first: int, n: int, ends: str) -> None:
        if self.stack:
            self._pop(common(self.key, key))
        self.key, self.words = key, words
        opening = not self.stack
        for depth in range(len(self.stack), len(key) // DIGEST + 1):
            node = _Node(not opening or depth > self.before)
            if node.started and self.stack:
                self.stack[-1].children += 1
            self.stack.append(node)
        top = self.stack[-1]
        top.n, top.first, top.ends = top.n + n, first if top.first is None else min(first, top.first), ends

    def _pop(self, keep: int) -> None:
        """Finish all nodes deeper than ``keep``."""
        waiting = None  # the child popped just before, whose parent is about to be known
        while len(self.stack) > keep + 1:
            depth, node = len(self.stack) - 1, self.stack.pop()
            onward = depth <= self._right
            if node.started and not onward and node.children == 0:
                node.leaves = 1
            words = self.words[depth - 1] if depth else 0
            node.saved += node.n * words - (words if node.started else 0)
            if self.stack:
                below = self.stack[-1]
                below.n += node.n
                below.first = node.first if below.first is None else min(below.first, node.first)
                below.leaves += node.leaves
                below.saved += node.saved
            is_open = onward or not node.started
            if waiting is not None:
                self._emit(waiting, None if is_open else node.first)
            waiting = (depth, node, is_open)
        if waiting is not None:
            self._emit(waiting, None)

    def _emit(self, popped: tuple[int, _Node, bool], parent_first: int | None) -> None:
        depth, node, is_open = popped
        name = _name(self.key, depth) if is_open or node.children > 1 else None
        parent = _name(self.key, depth - 1) if depth and parent_first is None else None
        self.out.append((name, parent, is_open, depth, node.first, parent_first, node.n, node.children, node.leaves, node.saved, node.ends))

    def finish(self) -> None:
        """After the last key: what reaches over the edge stays open."""
        self._right = self.after
        self._pop(-1)

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def _sweeps(edges: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            for part, key, words, first, n, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if sweep is None:
                    sweep = Sweep(*edges[part])
                sweep.add(key, words, first, n, ends)
                if len(sweep.out) >= 10_000:
                    yield sweep.take()
            if sweep is not None:
                yield sweep.take()
        if sweep is not None:
            sweep.finish()
            yield sweep.take()

    return run


def sequences_of(arrays: DataFrame) -> DataFrame:
    """``conv_id, key, kid, words`` of turn arrays."""
    rows = arrays.select("conv_id", F.array_join(F.transform("turns", lambda t: t["d"]), "").alias("key"), F.transform("turns", lambda t: t["w"]).alias("words"))
    return rows.select("conv_id", "key", F.md5("key").alias("kid"), "words")


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node over ``arrays(conv_id, turns)``.

    A node is a sequence of first turns, named by its depth and its smallest member. ``saved_tokens`` is what
    computing each shared prefix once saves in its subtree, in words.
    """
    rows = cut(sequences_of(arrays))
    distinct = rows.groupBy("kid", "key", "words").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).join(ends_of(rows), "kid")
    ordered = cut(distinct.select("key", "words", "first", "n", "ends").repartitionByRange("key").sortWithinPartitions("key")).withColumn("p", F.spark_partition_id())
    edge = ordered.groupBy("p").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    lcp = [tuple(r) for r in edge.repartition(1).sortWithinPartitions("p").mapInArrow(_neighbours, "p int, lcp int").collect()]  # two numbers a partition
    edges = {p: (before, after) for (p, before), (_, after) in zip(lcp, [*lcp[1:], (None, -1)])}
    found = cut(ordered.select("p", "key", "words", "first", "n", "ends").mapInArrow(_sweeps(edges), NODE))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where("open").groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    nodes = found.where("not open").drop("open").unionByName(parts)
    parents = nodes.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("of"))
    joined = nodes.where("parent is not null").join(parents, "parent").withColumn("parent_conv_id", F.col("of"))
    out = joined.drop("of").unionByName(nodes.where("parent is null"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` after their heads are shared."""
    return prefix_trie(with_shared_heads(turn_arrays(conversations)))
