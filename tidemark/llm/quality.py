"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: each word occurrence is the feature of its hashed word with
value 1/n, each structure statistic is the feature of the bin that it falls in, with value 1.
The machine's score is

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so all pairwise interactions cost time linear in the features. It is trained in numpy on the
driver by Adam, on a bounded sample of labelled rows: the ``SAMPLE`` rows whose ids have the
smallest hashes; of each text only its distinct hashed words come to the driver, at most
``WORDS``, with their counts. Scoring runs in tasks, vectorised over slices of a batch.

Defined results: a null or empty text has statistics of zero and is scored all the same; so
is every row, repeated or not. Null labels are not learnt. Without any label, or with labels
of one kind, every score is the share of 1 among them (0.5 if there are none). Extra columns
do not matter to the score. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.sampling import smallest_hashes

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 4000
#: Hashed words; after them come the bins of the statistics.
WORDS = 1 << 15
BINS = 12
FACTORS = 8

_CLASSES = ("upper", "lower", "digit", "newline", "stop", "bar", "bang", "symbol", "high")
_LOOKUP = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (10,), b".,;:", b"|", b"!", b"*#$%&@^~=+_<>{}[]\\/", range(128, 256))):
    _LOOKUP[_i, list(_chars)] = 1
#: The statistics, in the order of ``statistics``' columns.
STATISTICS = (*_CLASSES, "log_bytes", "log_words", "word_length", "distinct", "top_word", "repeats", "n_chars")


def statistics(w: words.Words, n_chars: np.ndarray) -> np.ndarray:
    """One row of structure statistics for each document."""
    rows = len(w.counts)
    size = np.diff(w.offsets)
    out = np.zeros((rows, len(STATISTICS)), np.float32)
    full = size > 0
    if full.any():
        at = w.offsets[:-1][full]
        for c in range(len(_CLASSES)):
            out[full, c] = np.add.reduceat(_LOOKUP[c][w.data], at, dtype=np.int64) / size[full]
    c = len(_CLASSES)
    n = np.maximum(w.counts, 1)
    out[:, c], out[:, c + 1] = np.log1p(size), np.log1p(w.counts)
    out[:, c + 2] = np.bincount(w.doc, w.ends - w.starts, rows) / n
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hashes >> np.uint64(24)))
    if len(key):
        new = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        of = (key[new] >> np.uint64(40)).astype(np.int64)
        out[:, c + 3] = np.bincount(of, minlength=rows) / n
        top = np.zeros(rows)
        np.maximum.at(top, of, np.diff(np.append(new, len(key))))
        out[:, c + 4] = top / n
        same = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[:, c + 5] = np.bincount(w.doc[1:], same, rows) / n
    out[:, c + 6] = np.log1p(np.maximum(n_chars, 0))
    return out


@dataclass
class FactorisationMachine:
    """Weights, factors, and the bins' bounds."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    bounds: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """The bin features of each row."""
        cols = range(stats.shape[1])
        return np.stack([WORDS + c * BINS + np.searchsorted(self.bounds[c], stats[:, c], side="right") for c in cols], axis=1)

    def sums(self, ix: np.ndarray, counts: np.ndarray, bins: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear part, sum of v x, and sum of v^2 x^2 for each row, which has ``counts`` of ``ix``, each occurring ``times`` (once)."""
        line = self.linear[bins].sum(axis=1)
        vx = self.factors[bins].sum(axis=1)
        v2 = (self.factors[bins] ** 2).sum(axis=1)
        some = counts > 0
        if some.any():
            at, n = (np.cumsum(counts) - counts)[some], counts[some].astype(np.float32)
            w, v = self.linear[ix], self.factors[ix]
            square = v * v
            if times is not None:
                n = np.add.reduceat(times, at).astype(np.float32)
                w, v, square = w * times, v * times[:, None], square * times[:, None]
            line[some] += np.add.reduceat(w, at) / n
            vx[some] += np.add.reduceat(v, at, axis=0) / n[:, None]
            v2[some] += np.add.reduceat(square, at, axis=0) / (n * n)[:, None]
        return line, vx, v2

    def score(self, ix: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        line, vx, v2 = self.sums(ix, counts, self.features(stats))
        z = self.bias + line + 0.5 * (vx * vx - v2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(docs: list[np.ndarray], often: list[np.ndarray], stats: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4) -> FactorisationMachine:
    """Train by Adam on the logistic loss. ``docs``: each row's distinct hashed words, and ``often`` how often each occurs."""
    rng = np.random.default_rng(7)
    size = WORDS + len(STATISTICS) * BINS
    m = FactorisationMachine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), np.zeros((len(STATISTICS), BINS - 1), np.float32))
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        m.factors[:] = 0
        m.bias = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30))
        return m
    m.bounds = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32).copy()
    m.bias = float(np.log(share / (1 - share)))
    bins = m.features(stats)
    params = [m.linear, m.factors]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            counts = np.array([len(docs[r]) for r in rows])
            ix = np.concatenate([docs[r] for r in rows]) if counts.sum() else np.zeros(0, np.int64)
            times = np.concatenate([often[r] for r in rows]).astype(np.float32) if counts.sum() else np.zeros(0, np.float32)
            total = np.array([often[r].sum() for r in rows], np.float32)
            line, vx, v2 = m.sums(ix, counts, bins[rows], times)
            z = m.bias + line + 0.5 * (vx * vx - v2).sum(axis=1)
            g = ((1 / (1 + np.exp(-z)) - label[rows]) / len(rows)).astype(np.float32)
            x = np.repeat(1 / np.maximum(total, 1), counts).astype(np.float32)
            of = np.concatenate((np.repeat(np.arange(len(rows)), counts), np.repeat(np.arange(len(rows)), bins.shape[1])))
            ids = np.concatenate((ix, bins[rows].ravel()))
            x = np.concatenate((x, np.ones(bins[rows].size, np.float32)))
            gx = g[of] * x * np.concatenate((times, np.ones(bins[rows].size, np.float32)))
            gw = np.bincount(ids, gx, size).astype(np.float32)
            gv = np.stack([np.bincount(ids, gx * (vx[of, f] - m.factors[ids, f] * x), size) for f in range(FACTORS)], axis=1).astype(np.float32)
            t += 1
            m.bias -= rate * float(g.sum())
            for k, (p, grad) in enumerate(zip(params, (gw, gv))):
                grad += decay * p
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                p -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return m


def _hashed(w: words.Words) -> np.ndarray:
    return (w.hashes >> np.uint64(20)).astype(np.int64) & (WORDS - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.utf8(batch.column(0))
        chars = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in words.slices(offsets):
            w = words.split(data, offsets[i : j + 1])
            key, times = np.unique(w.doc * WORDS + _hashed(w), return_counts=True)
            ends = np.searchsorted(key, np.arange(j - i + 1) * WORDS).astype(np.int32)
            stats = statistics(w, chars[i:j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((key % WORDS).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                    pa.array(list(stats), pa.list_(pa.float32())),
                    batch.column(2).slice(i, j - i),
                ],
                names=["ix", "times", "stats", "label"],
            )


def _scorer(model: FactorisationMachine, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            kept = pa.StructArray.from_arrays([pc.struct_field(row, k) for k in keep], names=list(keep))
            data, offsets = words.utf8(pc.struct_field(row, "text"))
            chars = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in words.slices(offsets):
                w = words.split(data, offsets[i : j + 1])
                s = model.score(_hashed(w), w.counts, statistics(w, chars[i:j]))
                yield pa.RecordBatch.from_arrays([kept.slice(i, j - i), pa.array(s)], names=["row", "score"])

    return run


def _n_chars(docs: DataFrame) -> Column:
    length = F.coalesce(F.length("text").cast("double"), F.lit(0.0))
    return F.coalesce(F.col("n_chars").cast("double"), length) if "n_chars" in docs.columns else length


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(F.col(key).cast("string")) % parts == part


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = smallest_hashes(rows, "doc_id", sample, "label")
    known = docs.select("doc_id", "text", _n_chars(docs).alias("chars")).join(F.broadcast(rows), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
    got = known.select("text", "chars", "label").mapInArrow(_features, "ix array<int>, times array<int>, stats array<float>, label int").toArrow()
    ix = got["ix"].combine_chunks()
    flat, ends = ix.flatten().to_numpy().astype(np.int64), np.cumsum(ix.value_lengths().to_numpy())[:-1]
    times = got["times"].combine_chunks().flatten().to_numpy()
    stats = np.asarray(got["stats"].combine_chunks().flatten().to_numpy(), np.float32).reshape(-1, len(STATISTICS))
    return fit(np.split(flat, ends), np.split(times, ends), stats, got["label"].to_numpy().astype(np.float32)) if len(ix) else fit([], [], stats, np.zeros(0, np.float32))


def score(docs: DataFrame, model: FactorisationMachine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the columns in ``keep``, and ``score`` for each row."""
    inputs = docs.select(F.struct(*dict.fromkeys(("text", *keep))).alias("row"), _n_chars(docs).alias("chars"))
    kept = T.StructType([docs.schema[k] for k in keep])
    return inputs.mapInArrow(_scorer(model, keep), T.StructType([T.StructField("row", kept), T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    return score(docs, train(docs, labels, sample)).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with their columns, that score ``threshold`` or more."""
    return score(docs, train(docs, labels, sample), tuple(docs.columns)).where(F.col("score") >= threshold).select("row.*")
