"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Each document is a set of word shingles. One pass over the texts hashes the shingles in
numpy and keeps, under each of ``PERMUTATIONS`` hash functions, both the smallest and the
largest value, so half the hash evaluations give a signature of the full length. Bands of
the signature name buckets. Documents with equal sets are one class from the start, so
copies never make pairs.

Before the texts of a pair are compared, its signatures are: of the ``2 * PERMUTATIONS`` values a byte
each is kept, and a pair that agrees in fewer than ``least_agreement`` of them is apart, but for a
probability of ``LOSS``. That is what keeps documents that are built from the same passages, and
are all somewhat alike, from being compared by their texts.

A bucket is not expanded into pairs at once. Its most central member (whose buckets hold the most
members, as the original of a group of edited copies does) leads it, and all others are held
against that one. What is left are pairs across components. Let a shingle that more than
``RARE`` of the documents concerned have be common, and m_x be the common ones of x; then

    |x & y| <= min(m_x, m_y) + (rare shingles that x and y share).

Pairs that share rare shingles are found by joining those, at most ``RARE`` rows to a
shingle. Any other pair can only be linked if both sizes fit each other and both m. Buckets are
divided by size, and the smallest size and the largest m in the other components of its bucket
rule out most documents. Buckets that are still open get ``LEADERS`` leaders more, members of the
smallest components first, then that many times as many, until each is settled. Every pair of a bucket is so confirmed, or is proven apart, or lies in one component.

Defined results: a null or empty text has an empty set, is in a class of its own and linked
to nothing. Ids are of any type that sorts. Rows are told apart by their own number, so null and repeated ids are documents
of their own: ``component_id`` is the smallest id reachable, null if there is none, and then
one row of the component is kept. Rows that share the id of the component are all kept.
Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm import words
from tidemark.plans.components import connected_components
from tidemark.plans.lineage import cut, new_table_path, parts_for

#: Hash functions; each gives a minimum and a maximum.
PERMUTATIONS = 128
#: Bands, and values of the signature in each. A pair at similarity 0.8 shares no
#: band with probability (1 - 0.8^4)^32 < 5e-8.
BANDS, BAND = 32, 4
#: The probability that a linked pair's signatures agree too little.
LOSS = 1e-7
#: Most documents that share a rare shingle.
RARE = 8
#: Leaders of a bucket that the first leader and the rare shingles leave open.
LEADERS = 64
#: Documents whose rows of any intermediate table lie in one file.
DOCS = 25_000
#: Most row numbers that are broadcast to pick out texts; beyond, texts are shuffled.
BROADCAST = 500_000

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MULT = _rng.integers(1, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minmax_signatures(sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document with shingles, the minima and maxima under every hash function, interleaved."""
    some = counts > 0
    at = (np.cumsum(counts) - counts)[some]
    out = np.zeros((int(some.sum()), 2 * PERMUTATIONS), np.uint64)
    for i, a in enumerate(_MULT if len(at) else ()):
        h = words.mix(sh) * a if i == 0 else sh * a
        h ^= h >> np.uint64(29)
        out[:, 2 * i] = np.minimum.reduceat(h, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, at)
    return out


def least_agreement(similarity: float, values: int = 2 * PERMUTATIONS, loss: float = LOSS) -> int:
    """The most values that two sets of this similarity agree in but for a probability of ``loss``."""
    below = 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * similarity**k * (1 - similarity) ** (values - k)
        if below > loss:
            return k
    return values


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each of the first ``BANDS`` bands; the band's number is part of it."""
    signatures = signatures[:, : BANDS * BAND]
    n, width = signatures.shape
    parts = signatures.reshape(n, width // BAND, BAND)
    key = (words.mix(parts) * _BAND_MULT).sum(axis=2, dtype=np.uint64)
    return words.mix(key + np.arange(width // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct_sets(sh: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, sorted, end to end, and how many there are."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((sh, doc))
    s, d = sh[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[fresh], np.bincount(d[fresh], minlength=len(counts))


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for i, j in words.slices(offsets):
                sh, n = words.shingles(words.split(data, offsets[i : j + 1]), shingle)
                sh, n = distinct_sets(sh, n)
                at = np.cumsum(n) - n
                some = n > 0
                k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if some.any():
                    k1[some] = np.add.reduceat(words.mix(sh + np.uint64(1)), at[some])
                    k2[some] = np.add.reduceat(words.mix(sh ^ np.uint64(0x6A09E667F3BCC909)), at[some])
                signatures = minmax_signatures(sh, n)
                keys = band_keys(signatures)
                bytes_of = signatures.astype(np.uint8).tobytes()  # the lowest byte of each value
                at_byte = np.concatenate(([0], np.cumsum(np.where(some, signatures.shape[1], 0)))).astype(np.int32)
                width = keys.shape[1]
                ends = np.concatenate(([0], np.cumsum(np.where(some, width, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at_byte.tobytes()), pa.py_buffer(bytes_of)]),
                    ],
                    names=["doc_id", "text", "n_shingles", "k1", "k2", "bands", "signature"],
                )

    return run


def _sets_of(column: pa.Array, shingle: int) -> list[np.ndarray]:
    data, offsets = words.utf8(column)
    out: list[np.ndarray] = []
    for i, j in words.slices(offsets):
        sh, n = distinct_sets(*words.shingles(words.split(data, offsets[i : j + 1]), shingle))
        out += np.split(sh, np.cumsum(n)[:-1])
    return out


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                runs = part.column(2).dictionary_encode()  # leaders repeat; each is split once
                lead = _sets_of(runs.dictionary, shingle)
                ok = np.zeros(part.num_rows, bool)
                for r, (x, k) in enumerate(zip(_sets_of(part.column(3), shingle), runs.indices.to_pylist())):
                    y = lead[k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok)], names=["u", "v", "linked"])

    return run


def _agree(least: int):
    """Whether the signatures of each pair agree in ``least`` values or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((u == v).sum(axis=1) >= least)], names=["u", "v", "near"])

    return run


def _terms(shingle: int):
    """Each text's distinct shingles, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for i, j in words.slices(offsets):
                sh, n = distinct_sets(*words.shingles(words.split(data, offsets[i : j + 1]), shingle))
                rep = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(sh.view(np.int64))], names=["rep", "s"])

    return run


def _of(rows: DataFrame, most: int, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` with the numbers in ``rows(row)``, which are distinct and ``most`` at most."""
    return texts.join(F.broadcast(rows) if most <= BROADCAST else rows, "row", "left_semi")


def _with_both(pairs: DataFrame, rows: DataFrame, most: int, texts: DataFrame, column: str) -> DataFrame:
    """``u, v`` of pairs with a ``column`` of each; ``rows(row)`` has all their numbers, ``most`` at most."""
    used = _of(rows, most, texts.select("row", column))
    both = pairs.join(used.withColumnsRenamed({"row": "v", column: "of_v"}), "v").join(used.withColumnsRenamed({"row": "u", column: "of_u"}), "u")
    return both.select("u", "v", "of_u", "of_v")


def _confirm_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, files: int) -> DataFrame:
    """``pairs(u, v)`` with ``linked``: whether their full sets are similar, for those whose signatures are."""
    pairs = cut(pairs, files)
    n = pairs.count()
    if n == 0:
        return pairs.withColumn("linked", F.lit(False))
    rows = pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct()
    near = _with_both(pairs, rows, 2 * n, texts, "signature").mapInArrow(_agree(least_agreement(percent / 100)), "u long, v long, near boolean")
    full = _with_both(near.where("near").select("u", "v"), rows, 2 * n, texts, "text").mapInArrow(_confirm(shingle, percent), "u long, v long, linked boolean")
    return cut(pairs.join(full.where("linked"), ["u", "v"], "left").withColumn("linked", F.col("linked").isNotNull()), files)


def _left(df: DataFrame, *same: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in same else f"l_{c}") for c in df.columns))


def _fits(n: str, other: str, percent: int) -> str:
    return f"100 * least({n}, {other}) >= {percent} * greatest({n}, {other})"


def _labelled(rows: DataFrame, parts: DataFrame, files: int) -> DataFrame:
    rows = rows.drop("component").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return cut(rows.withColumn("component", F.coalesce("component", "rep")), files)


def _mixed(rows: DataFrame, parts: DataFrame, files: int) -> DataFrame:
    """Rows of the buckets that lie in several components, with the component of each."""
    rows = _labelled(rows, parts, files)
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return cut(rows.join(keys, "key", "left_semi"), files)


def _open(rows: DataFrame, parts: DataFrame, percent: int, files: int) -> DataFrame:
    """Rows whose bucket may hold a partner in another component: one that is small enough, and has room enough.

    Of buckets with the same rows, one is enough. ``size`` is that of a row's component in its bucket.
    """
    rows = _labelled(rows.drop("size"), parts, files)
    groups = cut(rows.groupBy("key", "component").agg(F.min("n").alias("least"), F.max("room").alias("most"), F.count("*").alias("size")), files)
    ends = groups.groupBy("key").agg(F.min(F.struct("least", "component")).alias("a"), F.max(F.struct("most", "component")).alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    others = groups.join(ends, "key").groupBy("key", "a", "b").agg(F.expr("min(least) FILTER (WHERE component <> a.component)").alias("a2"), F.expr("max(most) FILTER (WHERE component <> b.component)").alias("b2"))
    least, most = F.expr("if(component = a.component, a2, a.least)"), F.expr("if(component = b.component, b2, b.most)")
    known = rows.join(others, "key").withColumn("least", least).withColumn("most", most)
    known = cut(known.where(f"{percent} * least <= room and {percent} * n <= most").select(rows.columns).join(groups.select("key", "component", "size"), ["key", "component"]), files)
    same = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit("row"), "rep")).alias("y"), F.count("*").alias("c")]
    keys = known.groupBy("key").agg(*same).groupBy("x", "y", "c").agg(F.min("key").alias("key"))
    return cut(known.join(keys.select("key"), "key", "left_semi"), files)


def _rare_pairs(rows: DataFrame, texts: DataFrame, shingle: int, percent: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that may be linked by the rare shingles that they share; and ``(rep, room)``: what a partner's size times ``percent`` may be if they share none."""
    members = cut(rows.select("rep", "n", "component").distinct(), files)
    known = cut(_of(members.select(F.col("rep").alias("row")), members.count(), texts.select("row", "text")).mapInArrow(_terms(shingle), "rep long, s long"), files)
    often = known.groupBy("s").agg(F.count("*").alias("often")).where(F.col("often") <= RARE)
    rare = cut(known.join(often, "s"), files)
    outside = rare.groupBy("rep").agg(F.count("*").alias("out"))
    members = cut(members.join(outside, "rep", "left").withColumn("m", F.col("n") - F.coalesce("out", F.lit(0))).drop("out"), files)
    met = rare.where("often > 1").select("s", "rep").join(members, "rep")
    pairs = _left(met, "s").join(met, "s").where(f"l_rep < rep and l_component <> component and {_fits('n', 'l_n', percent)}")
    pairs = pairs.groupBy("l_rep", "rep", "n", "l_n", "m", "l_m").agg(F.count("*").alias("c"))
    pairs = pairs.where(f"100 * (least(m, l_m) + c) >= {percent} * (n + l_n - least(m, l_m) - c)")
    return pairs.select(F.col("l_rep").alias("u"), F.col("rep").alias("v")), members.select("rep", F.expr(f"(100 + {percent}) * m - {percent} * n").alias("room"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable over links, and ``kept`` marks that document.
    """
    spark, path = docs.sparkSession, new_table_path(docs.sparkSession, "sketches")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketches = docs.mapInArrow(_sketch(shingle), f"doc_id {kind}, text string, n_shingles long, k1 long, k2 long, bands array<long>, signature binary")
    sketches.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    base = spark.read.parquet(path)
    texts = base.select("row", "text", "signature")
    files = parts_for(base.count(), DOCS)
    full = base.where("n_shingles > 0")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = cut(full.groupBy("k1", "k2").agg(first.alias("f")).select("k1", "k2", F.col("f.row").alias("rep"), "f.doc_id"), files)
    reps = full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    buckets = reps.select(F.explode("bands").alias("key"), F.col("row").alias("rep"), F.col("n_shingles").alias("n"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = cut(buckets.join(shared, "key"), files)
    central = rows.groupBy("rep").agg(F.sum("members").alias("central"))
    rows = cut(rows.drop("members").join(central, "rep"), files)

    rank = F.struct("central", F.xxhash64("rep"))
    leaders = cut(rows.groupBy("key").agg(F.max_by(F.struct("rep", "n"), rank).alias("l")).select("key", F.col("l.rep").alias("l_rep"), F.col("l.n").alias("l_n")), files)
    found = rows.join(leaders, "key").where(f"rep <> l_rep and {_fits('n', 'l_n', percent)}")
    checked = _confirm_pairs(found.select(F.least("l_rep", "rep").alias("u"), F.greatest("l_rep", "rep").alias("v")).distinct(), texts, shingle, percent, files)
    parts = connected_components(checked.where("linked").select("u", "v"), files=files)

    fresh = False  # links that the components don't have yet

    def settle(pairs: DataFrame, join: bool) -> None:
        nonlocal checked, parts, fresh
        more = _confirm_pairs(pairs.join(checked.select("u", "v"), ["u", "v"], "left_anti"), texts, shingle, percent, files)
        checked = checked.unionByName(more)
        fresh = fresh or not more.where("linked").isEmpty()
        if join and fresh:
            parts, fresh = connected_components(checked.where("linked").select("u", "v"), files=files), False

    rows = _mixed(rows.join(leaders.select("key", F.col("l_rep").alias("rep")), ["key", "rep"], "left_anti"), parts, files)
    if not rows.isEmpty():
        pairs, room = _rare_pairs(rows, texts, shingle, percent, files)
        settle(pairs, join=False)
        cell = F.floor(F.log("n") / (1.0001 * math.log(100 / percent)))  # sizes of similar sets are in one cell or in two next to each other
        rows = rows.join(room, "rep").withColumn("key", F.explode(F.array(F.xxhash64("key", cell), F.xxhash64("key", cell + 1))))
        rows, led = _open(rows, parts, percent, files), LEADERS
        while not rows.isEmpty():
            keys = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # a document has two for each band at most
            wide = rows.join(keys, "rep")
            place = F.row_number().over(W.partitionBy("key").orderBy("size", F.desc("central"), F.desc(F.xxhash64("rep"))))
            lead = cut(wide.withColumn("place", place).where(F.col("place") <= led).drop("place", "central"), files)
            fits = f"component <> l_component and {_fits('n', 'l_n', percent)} and {percent} * n <= l_room and {percent} * l_n <= room"
            found = _left(lead, "key").join(wide, "key").where(f"{fits} and array_min(array_intersect(keys, l_keys)) = key")  # each pair in one bucket only
            settle(found.select(F.least("l_rep", "rep").alias("u"), F.greatest("l_rep", "rep").alias("v")).distinct(), join=True)
            rest = rows.join(lead.select("key", "rep"), ["key", "rep"], "left_anti")
            rows, led = _open(rest, parts, percent, files), LEADERS * led
        if fresh:
            parts = connected_components(checked.where("linked").select("u", "v"), files=files)

    known = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = cut(known, files)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep"))
    named = cut(known.groupBy("component").agg(first.alias("f")).select("component", F.col("f.doc_id").alias("component_id"), F.col("f.rep").alias("keeper")), files)
    named = cut(known.drop("doc_id").join(named, "component").select("k1", "k2", "component_id", "keeper"), files)
    out = base.select("doc_id", "n_shingles", "k1", "k2", "row")
    linked = out.where("n_shingles > 0").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("keeper"))).alias("kept"))
    alone = out.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
