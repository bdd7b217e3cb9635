"""Exact top-k inner-product search over a pivot-distance index.

Vectors are scaled to integers. One more coordinate, sqrt(M^2 - |x|^2), gives all vectors
the largest norm M, so a larger inner product with a query is exactly a smaller distance to
it. The index keys every vector by its nearest pivot and its distance to that pivot, and is
laid out in that order: a run of rows is an annulus around a pivot. For a query at distance
d from the pivot, no vector of the annulus [lo, hi] is nearer than max(lo - d, d - hi); a
task visits its annuli from the nearest on and leaves out those that cannot beat a query's
k-th best so far. Survivors are scored in whole numbers.

Pivots come from a bounded sample (``SAMPLE`` rows of smallest id hash), which also gives
each query a first k-th best. Queries are held against the index in batches of about
``BATCH``, so that what is broadcast stays small.

Defined results: vectors that are null, or hold null or non-finite components, take no part;
a shorter vector counts as padded with zeros. Scores that tie go by the smaller vec_id. A
vec_id names a vector: rows with the query's own vec_id are no candidates, and of rows that
repeat a query's vec_id the smallest vector is the query. Extra columns are ignored. An empty
table gives an empty one. Scores beyond a long are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.sampling import smallest_hashes
from tidemark.plans.lineage import cut, new_table_path

SAMPLE = 4096
PIVOTS = 64
BATCH = 4096
#: Rows of an annulus that are scored at once.
RUN = 1024
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: the components times ``scale``, rounded down, of the vectors that take part."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def kth_best(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query, its k-th best score among the sample's rows; the least long where there are fewer."""
    out = np.full(len(ids), -(1 << 63), np.int64)
    for at in range(0, len(ids) if len(sample) >= k else 0, 256):
        s = _products(q[at : at + 256], sample)
        s[ids[at : at + 256, None] == sample_ids[None, :]] = -(1 << 63)
        out[at : at + 256] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    if not len(sample):
        return sample
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class _Best:
    """The k best candidates so far of each query."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids = np.concatenate((self.q, q)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score, q))  # ~ turns the order round
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])


def _assign(pivots: np.ndarray, width: int, norm2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column(1), width), norm2), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "v", "pivot", "dist"]
            )

    return run


def _search(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, pivots: np.ndarray, width: int, norm2: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        lifted = np.column_stack((q.astype(np.float64), np.zeros(len(q))))
        to_pivot = _distances(lifted, pivots)
        q2 = (lifted * lifted).sum(axis=1)
        slack = 1e-6 * (1 + norm2**0.5)
        best = _Best(floor, k)
        for batch in batches:
            x, vec = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            pivot, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            starts = np.unique(np.concatenate((np.arange(0, len(x), RUN), np.flatnonzero(np.diff(pivot)) + 1)))
            runs = list(zip(starts, np.append(starts[1:], len(x))))
            lo, hi = np.array([dist[a:b].min() for a, b in runs]), np.array([dist[a:b].max() for a, b in runs])
            d = to_pivot[:, pivot[starts]]
            least = np.maximum(np.maximum(lo - d, d - hi), 0)
            for r in np.argsort(least.min(axis=0), kind="stable"):
                a, b = runs[r]
                reach = np.sqrt(np.maximum(q2 + norm2 - 2 * best.floor.astype(np.float64), 0)) + slack
                live = np.flatnonzero(least[:, r] <= reach)
                s = _products(q[live], x[a:b])
                ok = (s >= best.floor[live][:, None]) & (ids[live][:, None] != vec[a:b])
                i, j = np.nonzero(ok)
                best.add(live[i], s[i, j], vec[a:b][j])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> tuple[DataFrame, dict]:
    """The index table, in annulus order and kept in the shared folder, and what a search needs to know of it."""
    known = vectors.agg(F.max(F.size("v")).alias("w"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("n")).first()
    width, norm2 = int(known.w or 0), float(known.n or 0.0)
    rows = smallest_hashes(vectors, "vec_id", sample, "v").toArrow()
    x = _matrix(rows["v"].combine_chunks(), width) if rows.num_rows else np.zeros((0, width), np.int64)
    facts = {"width": width, "norm2": norm2, "pivots": choose_pivots(_lift(x, norm2), pivots), "sample": x, "sample_ids": rows["vec_id"].to_numpy()}
    if not rows.num_rows:  # then there are no vectors
        return vectors.select("vec_id", "v", F.lit(0).alias("pivot"), F.lit(0.0).alias("dist")), facts
    keyed = vectors.mapInArrow(_assign(facts["pivots"], width, norm2), "vec_id long, v array<long>, pivot int, dist double")
    return cut(keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")), facts


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, batch: int = BATCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, its k best others."""
    spark = vectors.sparkSession
    index, facts = build_index(integers(vectors, scale))
    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    batches = max(1, -(-queries.count() // batch))
    path = new_table_path(spark, "top-k")
    for part in range(batches):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == part).toArrow()
        ids = rows["vec_id"].to_numpy()
        q = _matrix(rows["v"].combine_chunks(), facts["width"]) if rows.num_rows else np.zeros((0, facts["width"]), np.int64)
        floor = kth_best(ids, q, facts["sample_ids"], facts["sample"], k)
        found = index.mapInArrow(_search(ids, q, floor, facts["pivots"], facts["width"], facts["norm2"], k), "query_id long, vec_id long, score long")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.parquet(path)
