"""A positional inverted index over texts: words, phrases, and the best fragments of a hit.

The index is a table of postings ``(term, doc, positions)`` in directories by a hash of the term, so a
search opens the buckets of its terms only, and within them the row groups where the terms lie (files
are sorted by term). The postings of a frequent term are spread over ``spread`` files by document.

A term's postings hold one row a document. A phrase is a document's positions of each of its words,
moved back by the word's place, intersected within the row: no position leaves its document. Words are
runs of letters and digits, lower-cased.

Defined results: null texts, and rows without an id, have no postings. Rows that share an id are one
document each for words, and their positions are not told apart: ids should be unique. A phrase without
a word is in no document.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: what a word is made of.
WORD = r"[\p{L}\p{N}]+"
BUCKETS = 64
SPREAD = 4
#: Words of the documents that are dealt out together; a longer document is a block of its own.
BLOCK = 1_000_000


def words_of(text: str | Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def build(docs: DataFrame, path: str, doc: str, text: str, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Write the index of a text column (FL11). Postings are shuffled once, to the files that they end in, in blocks of documents.

    There are ``buckets * spread`` files, each a task's work: for large tables more of both, so that a file is about 1 GB.
    """
    found = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.pmod(F.xxhash64(doc), F.lit(spread)).cast("int").alias("part"), F.coalesce(words_of(text), F.array()).alias("words"))
    kind = found.schema["doc"].dataType.simpleString()
    blocks = found.mapInArrow(_blocks(buckets, spread), f"bucket int, part int, terms array<string>, documents array<int>, docs array<{kind}>, counts array<int>, positions array<int>")
    row = f"bucket int, term string, doc {kind}, positions array<int>"
    dealt = blocks.repartition(buckets * spread, "bucket", "part").mapInArrow(_postings, row)
    rows = dealt.sortWithinPartitions("bucket", "term", "doc").mapInArrow(_merged, row)
    rows.write.mode("overwrite").option("buckets", buckets).partitionBy("bucket").parquet(path)


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(term) if isinstance(term, str) else term), F.lit(buckets)).cast("int")


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, or of a single row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _blocks(buckets: int, spread: int):
    """The postings of each block of documents, a row for each file that they go to.

    ``terms`` are a row's words, ``documents`` how many documents each has, ``docs`` those documents, word after word,
    ``counts`` how often each has the word, and ``positions`` where.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(whole.column(2).value_lengths().to_numpy(), BLOCK):
                batch = whole.slice(a, b - a)
                words, sizes = batch.column(2).flatten().dictionary_encode(), batch.column(2).value_lengths().to_numpy()
                term, row = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                if not len(row):
                    continue
                position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                home = np.fromiter((zlib.crc32(t) % buckets for t in words.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(words.dictionary))
                file = home[term] * spread + batch.column(1).to_numpy()[row]
                in_term = file * len(home) + term
                order = np.argsort(in_term * len(sizes) + row, kind="stable")
                in_term, row = in_term[order], row[order]
                new_term = np.diff(in_term, prepend=-1) != 0
                pairs = np.flatnonzero(new_term | (np.diff(row, prepend=-1) != 0))
                terms = np.flatnonzero(new_term[pairs])  # where, among the pairs of a word and a document, a word begins
                file, of = file[order][pairs][terms], term[order][pairs][terms]
                files = np.flatnonzero(np.diff(file, prepend=-1))
                first = np.append(terms, len(pairs))[np.append(files, len(terms))]  # where, among the pairs, a file begins
                counts, ends = np.diff(np.append(pairs, len(row))), np.append(pairs, len(row))[first]
                per_file = _ends(np.diff(np.append(files, len(terms))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((file[files] // spread).astype(np.int32)),
                        pa.array((file[files] % spread).astype(np.int32)),
                        pa.ListArray.from_arrays(per_file, words.dictionary.take(pa.array(of))),
                        pa.ListArray.from_arrays(per_file, pa.array(np.diff(np.append(terms, len(pairs))).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), batch.column(0).take(pa.array(row[pairs]))),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(counts.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order].astype(np.int32))),
                    ],
                    names=["bucket", "part", "terms", "documents", "docs", "counts", "positions"],
                )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_blocks``, a row for each word and document."""
    for whole in batches:
        for a, b in _slices(whole.column(6).value_lengths().to_numpy(), BLOCK):
            batch = whole.slice(a, b - a)
            bucket, _, terms, documents, docs, counts, positions = batch.columns
            term = np.repeat(np.arange(len(terms.flatten())), documents.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(bucket.to_numpy(), docs.value_lengths().to_numpy())),
                    terms.flatten().take(pa.array(term)),
                    docs.flatten(),
                    pa.ListArray.from_arrays(_ends(counts.flatten().to_numpy()), positions.flatten()),
                ],
                names=["bucket", "term", "doc", "positions"],
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings with one row for each word and document: rows that share an id come from several blocks."""

    def merge(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        if len(starts) == batch.num_rows:
            return batch
        sizes = batch.column(3).value_lengths().to_numpy()
        flat, group = batch.column(3).flatten().to_numpy(), np.repeat(np.cumsum(np.isin(np.arange(len(sizes)), starts)), sizes)
        positions = pa.ListArray.from_arrays(_ends(np.add.reduceat(sizes, starts)), pa.array(flat[np.lexsort((flat, group))]))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in range(3)), positions], names=batch.schema.names)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        above, below = batch.slice(0, batch.num_rows - 1), batch.slice(1)
        same = np.logical_and.reduce([pc.equal(above.column(k), below.column(k)).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2)])
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        held = batch.slice(starts[-1])
        if len(starts) > 1:
            yield merge(batch.slice(0, starts[-1]), starts[:-1])
    if held is not None:
        yield merge(held, np.zeros(1, np.int64))


class Index:
    """An index that ``build`` has written with as many ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def postings(self, *terms: str) -> DataFrame:
        """``term, doc, positions`` of some terms; other buckets are not opened."""
        wanted = sorted({t.lower() for t in terms})
        homes = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket("term", self.buckets)).distinct().collect()]  # a number for each term
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(homes) & F.col("term").isin(wanted)).select("term", "doc", "positions")

    def phrase(self, text: str) -> DataFrame:
        """``doc, starts``: the documents that have these words next to each other, and the positions where they begin."""
        words = [r for (r,) in self.spark.createDataFrame([(text,)], "t string").select(F.explode(words_of("t"))).collect()]
        if not words:
            return self.postings("").select("doc", F.col("positions").alias("starts"))
        found = self.postings(*words).groupBy("doc").agg(*(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{k}") for k, w in enumerate(dict.fromkeys(words))))
        place = {w: f"w{k}" for k, w in enumerate(dict.fromkeys(words))}
        moved = [F.transform(place[w], _back(k)) for k, w in enumerate(words)]
        starts = functools.reduce(F.array_intersect, moved)
        return found.select("doc", starts.alias("starts")).where(F.size("starts") > 0)

    def word(self, text: str) -> DataFrame:
        """``doc, starts`` of a single word."""
        return self.postings(text).select("doc", F.col("positions").alias("starts"))


def _back(k: int):
    return lambda position: position - k


def any_of(*hits: DataFrame) -> DataFrame:
    """``doc, starts`` of documents that are among any of the hits."""
    every = functools.reduce(DataFrame.unionByName, hits)
    return every.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


def all_of(*hits: DataFrame) -> DataFrame:
    """``doc, starts`` of documents that are among all of the hits."""
    numbered = [h.withColumn("k", F.lit(k)) for k, h in enumerate(hits)]
    every = functools.reduce(DataFrame.unionByName, numbered).groupBy("doc").agg(F.countDistinct("k").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    return every.where(F.col("n") == len(hits)).drop("n")


def none_of(hits: DataFrame, *others: DataFrame) -> DataFrame:
    """``doc, starts`` of the hits that are among none of the others."""
    return functools.reduce(lambda h, o: h.join(o.select("doc"), "doc", "left_anti"), others, hits)


def fragments(docs: DataFrame, hits: DataFrame, doc: str, text: str, size: int = 12, most: int = 2) -> DataFrame:
    """``doc, fragment, place, n``: the ``most`` runs of ``size`` words that hold most hits, in page order, hits in ``<b>`` (FN37).

    A document is cut into runs from its first word; of runs that hold as many hits the earlier is taken.
    """
    cells = hits.select("doc", F.transform("starts", lambda p: F.floor(p / size).cast("int")).alias("cells"), "starts")
    counted = F.transform(F.array_distinct("cells"), lambda c: F.struct((-F.size(F.filter("cells", lambda x: x == c))).alias("n"), c.alias("cell")))
    best = cells.withColumn("best", F.slice(F.array_sort(counted), 1, most))
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(best, "doc").withColumn("words", words_of("text"))  # texts take less of a shuffle than their words
    one = rows.select("doc", "words", "starts", F.explode("best").alias("b"))
    run = F.slice("words", F.col("b.cell") * size + 1, size)
    marked = F.transform(run, lambda w, k: F.when(F.array_contains("starts", k + F.col("b.cell") * size), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return one.select("doc", F.array_join(marked, " ").alias("fragment"), F.col("b.cell").alias("place"), (-F.col("b.n")).alias("n"))
