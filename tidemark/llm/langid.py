"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards, labels every position with
language probabilities, and a document's probabilities are the means over its positions. It
is trained in numpy by backpropagation through time on the driver, on a bounded sample: at
most ``SAMPLE_DOCS`` labelled documents, those with the smallest id hashes, and at most
``SAMPLE_WORDS`` of their distinct (word or piece, language) pairs.

A word always gets the same labels, so a task runs the network once for each distinct word
and adds its sums for every occurrence; words of over ``PIECE`` bytes are read in pieces.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties go to
the language that sorts first. Every row is labelled on its own, so repeats do not matter;
texts are read whole; extra columns do not matter. Without any learnable row all is ``und``.
An empty table gives an empty one.
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

SAMPLE_DOCS = 2000
SAMPLE_WORDS = 24_000
#: The share of held-out documents that may fall below the least evidence, its least distance from chance, as a share of
#: the way to 1, and the steps from 0 to 1 that evidence is counted in.
LOST = 0.001
MARGIN = 0.1
STEPS = 10_000
#: Longest run of bytes that is read as one sequence.
PIECE = 24
HIDDEN = 12
#: Distinct words whose labels a task remembers.
MEMO = 600_000


@dataclass
class Direction:
    """One reading direction: input table, recurrent weights and bias, for gates update, reset, candidate."""

    table: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, HIDDEN) for byte ids x (steps, rows), and what backpropagation needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)):
            a, b = self.table[x[t]], h @ self.hidden + self.bias
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            saved.append((h, z, r, n, b[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, saved

    def back(self, x: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, hidden and bias for gradients of the states."""
        gt, gh, gb = np.zeros_like(self.table), np.zeros_like(self.hidden), np.zeros_like(self.bias)
        carry = np.zeros_like(saved[0][0])
        for t in reversed(range(len(x))):
            h, z, r, n, c = saved[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            da = np.concatenate((dz, dr, dn), axis=1)
            db = np.concatenate((dz, dr, dn * r), axis=1)
            np.add.at(gt, x[t], da)
            gh += h.T @ db
            gb += db.sum(axis=0)
            carry = d * z + db @ self.hidden.T
        return [gt, gh, gb]


@dataclass
class Network:
    """Both directions, the output layer, and the languages."""

    forward: Direction
    backward: Direction
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probabilities (steps, rows, languages) at every position."""
        f, fs = self.forward.run(x)
        b, bs = self.backward.run(x[::-1])
        h = np.concatenate((f, b[::-1]), axis=2)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        return p, (h, fs, bs)


def _by_length(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of equal length: their places, and their bytes (steps, rows)."""
    for n in np.unique(lengths):
        for part in np.array_split(which := np.flatnonzero(lengths == n), max(1, len(which) // 4096)):
            yield part, data[starts[part] + np.arange(n)[:, None]]


def train_network(samples: list[tuple[bytes, int, float]], languages: list[str], epochs: int = 6, rate: float = 0.01) -> Network:
    """Backpropagation through time and Adam on ``(piece of a word, language, weight)``."""
    rng = np.random.default_rng(11)

    def direction() -> Direction:
        return Direction(
            rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32), np.zeros(3 * HIDDEN, np.float32)
        )

    net = Network(direction(), direction(), rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), languages)
    params = [net.forward.table, net.forward.hidden, net.forward.bias, net.backward.table, net.backward.hidden, net.backward.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    data = np.frombuffer(b"".join(s[0] for s in samples), np.uint8)
    lengths = np.array([len(s[0]) for s in samples])
    starts = np.cumsum(lengths) - lengths
    label, weight = np.array([s[1] for s in samples]), np.array([s[2] for s in samples], np.float32)
    weight /= weight.mean()
    batches = [(b[k], x[:, k]) for b, x in _by_length(data, starts, lengths) for k in np.array_split(rng.permutation(len(b)), max(1, len(b) // 256))]
    for epoch in range(epochs):
        for i in rng.permutation(len(batches)):
            rows, x = batches[i]
            p, (h, fs, bs) = net.labels(x)
            dz = p.copy()
            dz[:, np.arange(len(rows)), label[rows]] -= 1
            dz *= (weight[rows] / (len(rows) * len(x)))[None, :, None]
            dh = dz @ net.out.T
            grads = net.forward.back(x, fs, dh[:, :, :HIDDEN]) + net.backward.back(x[::-1], bs, dh[::-1, :, HIDDEN:])
            grads += [np.tensordot(h, dz, axes=([0, 1], [0, 1])), dz.sum(axis=(0, 1))]
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                params[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _label_words(net: Network, w: words.Words, which: np.ndarray) -> np.ndarray:
    """For the words in ``which``, the sums of their positions' probabilities."""
    starts, sizes = w.starts[which], w.ends[which] - w.starts[which]
    pieces = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(which)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    out = np.zeros((len(which), len(net.languages)), np.float32)
    for part, x in _by_length(w.data, starts[of] + k * PIECE, np.minimum(sizes[of] - k * PIECE, PIECE)):
        sums = net.labels(x)[0].sum(axis=0)
        if pieces.max() == 1:
            out[of[part]] = sums
        else:
            np.add.at(out, of[part], sums)
    return out


def _labeller(net: Network, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = np.zeros(0, np.uint64), np.zeros((0, len(net.languages)), np.float32)
        for batch in batches:
            row = batch.column(0)
            kept = pa.StructArray.from_arrays([pc.struct_field(row, k) for k in keep], names=list(keep))
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = words.utf8(pc.struct_field(row, "text"))
            for i, j in words.slices(offsets):
                w = words.split(data, offsets[i : j + 1], lower=False)
                here, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
                at = np.searchsorted(known, here)
                old = np.zeros(len(here), bool)
                inside = at < len(known)
                old[inside] = known[at[inside]] == here[inside]
                value = np.empty((len(here), len(net.languages)), np.float32)
                value[old] = sums[at[old]]
                if not old.all():
                    value[~old] = fresh = _label_words(net, w, first[~old])
                    if len(known) > MEMO:
                        known, sums = here, value
                    else:
                        known = np.concatenate((known, here[~old]))
                        order = np.argsort(known, kind="stable")
                        known, sums = known[order], np.concatenate((sums, fresh))[order]
                total = np.stack([np.bincount(w.doc, value[place, c], len(w.counts)) for c in range(len(net.languages))], axis=1).astype(np.float64)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
                best = total.argmax(axis=1)
                ok = letters[i:j]
                names = np.where(ok, np.asarray(net.languages, object)[best], "und")
                score = np.where(ok, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([kept.slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows whose language is never learnt."""
    return F.crc32(F.col(key).cast("string")) % parts == part


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Network | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; None if there are none."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    rows = smallest_hashes(rows, "doc_id", sample_docs, "lang", F.xxhash64("text"))
    found = rows.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    word = "cast(word AS binary)"
    pieces = F.expr(f"transform(sequence(1, length({word}), {PIECE}), i -> substring({word}, i, {PIECE}))")
    counts = found.select("lang", F.explode(pieces).alias("word")).groupBy("lang", "word").count()
    got = smallest_hashes(counts, "word", sample_words, "lang").collect()
    languages = sorted({r.lang for r in got})
    samples = [(bytes(r.word), languages.index(r.lang), r["count"] ** 0.5) for r in got]
    return train_network(samples, languages) if samples else None


def label(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the columns in ``keep``, with ``lang_pred`` and ``score``."""
    kept = T.StructType([docs.schema[k] for k in keep])
    if net is None:
        return docs.select(F.struct(*keep).alias("row"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    inputs = docs.select(F.struct(*dict.fromkeys(("text", *keep))).alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([T.StructField("row", kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inputs.mapInArrow(_labeller(net, keep), schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text, lang)``."""
    return label(docs, train(docs)).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def _evidence(languages: int) -> Column:
    """The score, drawn to chance by the share of the text's characters that are no letters: digits and signs name no language."""
    letters, shown = F.length(F.regexp_replace("row.text", r"[^\p{L}\p{M}]+", "")), F.length(F.regexp_replace("row.text", r"\s+", ""))
    return F.lit(1 / languages) + (F.col("score") - 1 / languages) * letters / F.greatest(shown, F.lit(1))


def least_evidence(docs: DataFrame, net: Network) -> float:
    """What a document's evidence must reach, from the evidence of held-out rows that are labelled as they should be.

    All such rows count. All but one in ``1 / LOST`` of them reach it, to a step of ``1 / STEPS`` below that quantile, and it
    is at least ``MARGIN`` of the way from chance to 1. Where there are too few of them to tell such a quantile, the
    margin decides. One language can't be told from others.
    """
    n = len(net.languages)
    if n == 1:
        return 0.0
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out()).select("lang", "text")
    right = label(rows, net, ("lang", "text")).where("row.lang = lang_pred")
    got = right.groupBy(F.floor(_evidence(n) * STEPS).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()  # STEPS + 1 rows at most
    ends = np.cumsum([r.n for r in got])
    margin = 1 / n + MARGIN * (1 - 1 / n)
    if not got or ends[-1] * LOST < 1:
        return margin
    return max(margin, got[int(np.searchsorted(ends, ends[-1] * LOST))].step / STEPS)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is found with as much evidence as ``least_evidence`` asks for."""
    net = train(docs)
    known = label(docs, net, tuple(docs.columns)).where("lang_pred <> 'und'")
    if net is not None:
        known = known.where(_evidence(len(net.languages)) >= least_evidence(docs, net))
    return known.select("row.*")
