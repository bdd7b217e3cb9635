"""Byte-level BPE: encoding by a fold of ranked merges in Spark's higher-order functions, and decoding.

The texts are cut by the tokenizer's pattern in the JVM. Each task keeps a table of the
distinct pieces it has met; only pieces new to it go, as byte arrays, through the fold,
which merges the adjacent pair of lowest rank again and again by a rank map held in two
arrays (a perfect hash of pairs). The ranks of a piece's pairs are kept beside its ids, so
that a merge looks up only the two pairs that it makes. A text's ids are then the table's entries in the
order of its pieces. No text is shuffled, and a task that is lost is simply run again.

Every task's table begins with the same frequent pieces: the ``FREQUENT`` most frequent of a
sample of about ``SAMPLE`` documents, folded once and broadcast. They only save work; a piece
that is not among them is folded in each task that has it, since joining the ids of rare
pieces back to their places would shuffle more than the input.

Decoding concatenates the byte strings of the ids.

Defined results: a null or empty text has no ids. Special tokens are ordinary text. Every
row is encoded on its own, so repeated rows and ids do not matter. Columns other than the
two that are named are ignored. An empty table gives an empty one. Very long texts are
encoded whole; pieces of over ``LONG`` bytes, for which a fold would take quadratic time,
are merged with a heap instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.lineage import new_table_path

#: Pieces of more bytes than this are merged with a heap.
LONG = 512
#: A task forgets its table of pieces when it has so many, to bound its memory.
TABLE = 350_000
#: Documents in the sample for frequent pieces, and most pieces kept of them.
SAMPLE, FREQUENT = 6000, 3 << 16

#: Pieces whose ids are put together at a time.
SPAN = 1 << 19

_BUCKETS, _SLOTS = 1 << 16, 1 << 17
_M1, _M2 = 0x2C1B3C6D, 0x297A2D39
_NONE = 1 << 16  # above every rank: of pairs that don't merge
_RANK, _AT = 26, 16  # bits of a fold's entries: a pair's rank from the first, the place of its left id from the second, that id below


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank map: entries of two bytes that meet, displacements and slots of a perfect hash of pairs."""
    ranks = load_ranks(path)
    if max(ranks.values()) >= _NONE - 1:
        raise ValueError("ranks must be less than 65535, which stands for the edges of a piece")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[(a << 16) | b] = rank
    key = np.fromiter(pairs, np.int64, len(pairs))
    bucket = (key * _M1 >> 22) & (_BUCKETS - 1)
    place = key * _M2 >> 24
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    slots, shift = np.zeros(_SLOTS, np.int64), np.zeros(_BUCKETS, np.int64)
    taken = np.zeros(_SLOTS, bool)
    for g in sorted(groups, key=len, reverse=True):
        p = place[g]
        for d in range(_SLOTS):
            at = (p + d) & (_SLOTS - 1)
            if not taken[at].any() and len(np.unique(at)) == len(at):
                break
        else:
            raise ValueError("no perfect hash of the merge pairs was found")
        taken[at] = True
        slots[at] = (key[g] << 16) | np.array([pairs[k] for k in key[g].tolist()])
        shift[bucket[g[0]]] = d
    slots[~taken] = 1 << 61  # no pair's
    byte = [bytes([b]) for b in range(256)]
    return np.array([(ranks.get(a + b, _NONE) << _RANK) | ranks[a] for a in byte for b in byte] + [(_NONE << _RANK) | ranks[a] for a in byte]), shift, slots


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the finish of a fold over nothing, which copies no value as an array's element would be."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def with_folds(rows: DataFrame, name: str, ranks_path: str, body: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
    """``rows`` with the column ``name`` that ``body`` makes of the fold of a piece.

    The rank map's arrays are scalar subqueries: as literals their digits would stand in every text of the plan that the
    driver keeps. Spark puts each into its one use, so no row holds them.
    """
    spark, path, names = rows.sparkSession, new_table_path(rows.sparkSession, "ranks"), ["meet", "shift", "slots"]
    spark.createDataFrame(pa.table({n: pa.array([x.tolist()], pa.list_(pa.int64())) for n, x in zip(names, _tables(ranks_path))})).coalesce(1).write.parquet(path)
    given = rows.select("*", *(spark.read.parquet(path).select(n).scalar().alias(f"__{n}") for n in names))
    folds = _let(F.array(*(F.col(f"__{n}") for n in names)), lambda t: _let(t[0], lambda a: _let(t[1], lambda b: _let(t[2], lambda c: body(lambda piece: fold_merges(piece, a, b, c))))))
    return given.select(*(c for c in rows.columns if c != name), folds.alias(name))


def fold_merges(piece: Column, meet: Column, shift: Column, slots: Column) -> Column:
    """The ids of one piece, given as an array of byte values: each step merges the first pair of the lowest rank.

    The fold goes over an array of entries, one an id, with an edge at either end that merges with nothing: the rank of the
    id and the next one as a pair, the place of the id's first byte, the id. The least entry is the pair to merge.
    """
    edge = F.array(F.lit((_NONE << _RANK) | (_NONE - 1)))

    def start(b: Column, i: Column) -> Column:
        """A byte and the next; what ends a piece meets none."""
        after = F.coalesce(F.shiftleft(b, 8) + F.get(piece, i + 1), b + (1 << 16))
        return meet[after].bitwiseOR(F.shiftleft(i.cast("long"), _AT))

    def ranked(left: Column, right: Column) -> Column:
        """The rank of a pair of ids, in its bits."""
        k = F.shiftleft(left, 16).bitwiseOR(right)
        return _let(k, lambda k: F.shiftleft(F.least(slots[hashed(k)].bitwiseXOR(F.shiftleft(k, 16)), F.lit(_NONE).cast("long")), _RANK))

    def hashed(k: Column) -> Column:
        return (F.shiftright(k * _M2, 24) + shift[F.shiftright(k * _M1, 22).bitwiseAND(_BUCKETS - 1)]).bitwiseAND(_SLOTS - 1)

    def step(entries: Column, _: Column) -> Column:
        def merged(best: Column, at: Column) -> Column:
            new, before, after = F.shiftright(best, _RANK), entries[at - 2], entries[at + 1].bitwiseAND(_NONE - 1)
            ahead = ranked(before.bitwiseAND(_NONE - 1), new).bitwiseOR(before.bitwiseAND((1 << _RANK) - 1))
            here = ranked(new, after).bitwiseOR(best.bitwiseAND((1 << _RANK) - _NONE)).bitwiseOR(new)
            return F.flatten(F.array(F.slice(entries, F.lit(1), at - 2), F.array(ahead, here), F.slice(entries, at + 2, F.size(entries))))

        return _let(F.array_min(entries), lambda best: F.when(best < (_NONE << _RANK), _let(F.array_position(entries, best).cast("int"), lambda at: merged(best, at))).otherwise(entries))

    ended = F.aggregate(piece, F.concat(edge, F.transform(piece, start), edge), step)
    return _let(ended, lambda entries: F.transform(F.slice(entries, F.lit(2), F.size(entries) - 2), lambda x: x.bitwiseAND(_NONE - 1)))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long piece, in O(n log n)."""
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        a, j = part[i], right[i]
        if a is None or j < 0 or ranks.get(a + part[j]) != r:
            continue
        part[i], part[j] = a + part[j], None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (r := ranks.get(part[x] + part[right[x]])) is not None:
                heapq.heappush(heap, (r, x))
    return [ranks[p] for p in part if p is not None]


def _byte_lists(pieces: list[bytes]) -> pa.Array:
    """Pieces as lists of byte values; what is too long to fold gives null."""
    short = [p if len(p) <= LONG else b"" for p in pieces]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in short]))).astype(np.int32)
    values = np.frombuffer(b"".join(short), np.uint8).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _places(frequent: Broadcast) -> dict[bytes, int]:
    return {p: k for k, p in enumerate(_frequent_table(frequent)["piece"].to_pylist())}


_INDEXED = "key long, ix array<int>, fresh int, new array<array<int>>, long array<binary>"


def _index(frequent: Broadcast):
    """Replace pieces by places in the task's table; pieces new to it come with a batch's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _places(frequent)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(1)
                flat = lists.flatten().cast(pa.binary()).dictionary_encode()
                if len(table) > TABLE:
                    table.clear()  # before it is made anew, so that two are never held
                    table = _places(frequent)
                fresh, new, place = len(table), [], []
                for p in flat.dictionary.to_pylist():
                    k = table.get(p)
                    if k is None:
                        k = table[p] = len(table)
                        new.append(p)
                    place.append(k)
                ix = np.asarray(place, np.int32)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                rows = batch.num_rows
                first = pa.array([0] + [len(new)] * rows, pa.int32())
                long = [p for p in new if len(p) > LONG]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ix)),
                        pa.array([fresh] + [-1] * (rows - 1), pa.int32()),
                        pa.ListArray.from_arrays(first, _byte_lists(new)),
                        pa.ListArray.from_arrays(pa.array([0] + [len(long)] * rows, pa.int32()), pa.array(long, pa.binary())),
                    ],
                    names=["key", "ix", "fresh", "new", "long"],
                )

    return run


def _spelled(ids: pa.ListArray, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """For each list of ids their words, one after the other."""
    flat = words.take(ids.flatten())
    starts = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[_ends(ids)]), flat.buffers()[2]])


def _ends(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))


def _runs(batches: Iterator[pa.RecordBatch], frequent: Broadcast, tokens: pa.LargeBinaryArray, made: Callable[[pa.ListArray], list[pa.Array]]):
    """``(keys, places, columns)`` for runs of rows that have at most ``SPAN`` pieces or are one.

    The columns are what ``made`` makes of the ids of the task's table. They are Arrow arrays: as Python objects they
    took several times the memory.
    """
    ids = _frequent_table(frequent)["ids"].combine_chunks()
    base, start, ranks = made(ids), len(ids), {}
    table = base
    for batch in batches:
        fresh, ends = batch.column(2).to_numpy(zero_copy_only=False), _ends(batch.column(1))
        at = 0
        while at < batch.num_rows:
            if fresh[at] >= 0:
                new, long = batch.column(3)[at].values, batch.column(4)[at].as_py()
                if long:
                    ranks, rest = ranks or {t: k for k, t in enumerate(tokens.to_pylist())}, iter(long)
                    new = pa.array([i or merge_long(next(rest), ranks) for i in new.to_pylist()], ids.type)
                table = base if fresh[at] == start else table
                table = [pa.concat_arrays(c) for c in zip(table, made(new))] if len(new) else table
            later = np.flatnonzero(fresh[at + 1 :] >= 0)
            to = min(at + 1 + later[0] if len(later) else batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + SPAN, "right")) - 1))
            yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), table
            at = to


def _tokens(path: str) -> pa.LargeBinaryArray:
    """Tokens by rank: read on the driver only, tasks get them with their code."""
    by_rank = {r: b for b, r in load_ranks(path).items()}
    return pa.array([by_rank.get(r, b"") for r in range(max(by_rank) + 1)], pa.large_binary())


def _digest(path: str, frequent: Broadcast):
    tokens = _tokens(path)
    numbers = pa.array([b"%d " % r for r in range(len(tokens))], pa.large_binary())

    def made(ids: pa.ListArray) -> list[pa.Array]:
        return [ids.value_lengths().cast(pa.int64()), _spelled(ids, numbers), _spelled(ids, tokens)]

    def hashes(words: pa.LargeBinaryArray, ends: np.ndarray, less: int) -> list[str]:
        """Digests of what runs of words give, without the last ``less`` bytes of each."""
        if not len(words):
            return [hashlib.sha256().hexdigest()] * (len(ends) - 1)
        data, at = memoryview(words.buffers()[2] or b""), np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[ends].tolist()
        return [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, (size, text, raw) in _runs(batches, frequent, tokens, made):
            ix, ends = places.flatten(), _ends(places)
            total = np.concatenate(([0], np.cumsum(size.take(ix).to_numpy())))[ends]
            out = [keys, pa.array(np.diff(total)), pa.array(hashes(text.take(ix), ends, 1)), pa.array(hashes(raw.take(ix), ends, 0))]
            yield pa.RecordBatch.from_arrays(out, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, frequent: Broadcast):
    tokens = _tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, (ids,) in _runs(batches, frequent, tokens, lambda ids: [ids]):
            taken = ids.take(places.flatten())
            out = pa.ListArray.from_arrays(pa.array(_ends(taken)[_ends(places)].astype(np.int32)), taken.flatten())
            yield pa.RecordBatch.from_arrays([keys, out], names=["key", "ids"])

    return run


def _pieces(docs: DataFrame, pattern: str, key: str, text: str) -> DataFrame:
    pieces = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return docs.select(F.col(key).cast("long").alias("key"), pieces.alias("pieces"))


def _split_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column(0).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), _byte_lists(pieces)], names=["piece", "bytes"])


def frequent_pieces(docs: DataFrame, ranks_path: str, pattern: str, key: str, text: str) -> Broadcast:
    """The most frequent pieces of a bounded sample and their ids, as an Arrow table in bytes."""
    sample = docs.where(F.rand(5) < SAMPLE / max(1, docs.count()))
    counts = _pieces(sample, pattern, key, text).select(F.explode("pieces").alias("piece")).where(F.octet_length("piece") <= LONG).groupBy("piece").agg(F.count("*").alias("n"))
    spark, path = docs.sparkSession, new_table_path(docs.sparkSession, "pieces")
    top = counts.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece")
    top.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)  # so that the rank literals are planned once, without a shuffle
    pieces = spark.read.parquet(path).mapInArrow(_split_bytes, "piece binary, bytes array<int>")
    got = with_folds(pieces, "ids", ranks_path, lambda fold: fold(F.col("bytes")).cast("array<int>")).select("piece", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, got.schema) as out:
        out.write_table(got)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _frequent_table(frequent: Broadcast) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(frequent.value)).read_all()


def _pieces_encoded(docs: DataFrame, frequent: Broadcast, ranks_path: str, pattern: str, key: str, text: str) -> DataFrame:
    indexed = _pieces(docs, pattern, key, text).mapInArrow(_index(frequent), _INDEXED)
    folded = with_folds(indexed, "new", ranks_path, lambda fold: F.transform("new", lambda p: fold(p).cast("array<int>")))
    return folded.select(*indexed.columns)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` for every row: the token ids of its whole text."""
    frequent = frequent_pieces(docs, ranks_path, pattern, key, text)
    rows = _pieces_encoded(docs, frequent, ranks_path, pattern, key, text)
    return rows.mapInArrow(_ids(ranks_path, frequent), "key long, ids array<int>").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` for every row: what its ids are and decode to."""
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    frequent = frequent_pieces(docs, ranks_path, pattern, key, text)
    rows = _pieces_encoded(docs, frequent, ranks_path, pattern, key, text)
    return rows.mapInArrow(_digest(ranks_path, frequent), schema).withColumnRenamed("key", key)


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that an array of ids stands for: its tokens' binary pieces, concatenated."""
    ranks = load_ranks(ranks_path)
    token = [""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        token[r] = b.hex()
    hexes = F.split(F.lit(",".join(token)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), ""))
