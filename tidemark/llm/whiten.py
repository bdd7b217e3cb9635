"""Whitening of embeddings: covariance by generated column aggregates, components by LAPACK.

Every pair of dimensions (i <= j) has an SQL expression of its own that sums products of centred
entries; all of them are one aggregation, which Spark combines on the map side, so that a task
sends one row however many vectors it has read. Vectors wider than ``TILE`` are cut into tiles: a
row then comes once for each pair of tiles, and the pairs within it are the same expressions,
grouped by the pair of tiles. The matrix (dimensions squared) is all that reaches the driver,
where LAPACK decomposes it.

Entries are whole numbers, so sums are exact; a product is of n * x - S, taken exactly and then
divided by n, which centres before it multiplies and loses no digit to the mean. What the
projection is worth is measured, not assumed: the covariance of the whitened vectors is one more
such aggregation.

Defined results: vectors that are null, or hold null or non-finite entries, take no part. A
shorter vector counts as padded with zero entries. Entries whose whole number would leave
[-2^52, 2^52] are held at its ends. A null vec_id, and rows that repeat, are rows of their own; a
repeated vector counts once in the fit. ``deviation`` is null where it exceeds a long. A
component without variance (an eigenvalue below 1e-12 of the sum) can't be whitened: ``whitened``
is null there, and it is left out of ``identity_error``. Extra columns are ignored. An empty
table, or one of empty vectors, gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.lineage import cut

#: Dimensions whose pairs are one set of expressions.
TILE = 16
#: Components that a row is projected on.
COMPONENTS = 16
_LEAST = 1e-12
_WIDEST = 1 << 52


def whole_vectors(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x``: entries as whole numbers, of the vectors that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(float(-_WIDEST))), F.lit(float(_WIDEST)))).cast("long") + shift)
    return vectors.where(F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def _padded(rows: DataFrame, width: int, shift: int = 1_000_000) -> DataFrame:
    pad = F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", pad)).otherwise(F.col("x")))


def pair_sums(rows: DataFrame, centred: list[str], tile: int = TILE) -> np.ndarray:
    """The symmetric matrix of sums over ``rows`` of products of each two of the ``centred`` SQL expressions."""
    d = len(centred)
    tiles = [range(a, min(a + tile, d)) for a in range(0, d, tile)]
    out = np.zeros((d, d))
    if len(tiles) == 1:
        named = rows.select(*(F.expr(e).alias(f"c{i}") for i, e in enumerate(centred)))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        sums = named.agg(*(F.expr(f"sum(c{i} * c{j})") for i, j in pairs)).first()
        for (i, j), s in zip(pairs, sums):
            out[i, j] = out[j, i] = s or 0.0
        return out
    entries = F.array(*(F.expr(e) for e in centred))
    cuts = [F.slice("c", t[0] + 1, len(t)) for t in tiles]
    both = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cuts[a].alias("u"), cuts[b].alias("v")) for a in range(len(tiles)) for b in range(a, len(tiles))))
    cells = [(i, j) for i in range(tile) for j in range(tile)]
    sums = rows.select(entries.alias("c")).select(F.inline(both)).groupBy("a", "b").agg(*(F.expr(f"sum(get(u, {i}) * get(v, {j}))") for i, j in cells))
    for a, b, *row in sums.collect():  # a row for each pair of tiles
        for (i, j), s in zip(cells, row):
            if s is not None and i < len(tiles[a]) and j < len(tiles[b]):
                out[tiles[a][i], tiles[b][j]] = out[tiles[b][j], tiles[a][i]] = s
    return out


class Fit:
    """What a whitening is fitted to: the number of different vectors, their sums, eigenvalues and unit eigenvectors."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, wide: bool, most: int = COMPONENTS):
        self.n, self.sums, self.wide = n, sums, wide
        values, vectors = np.linalg.eigh(covariance)
        self.trace = float(np.trace(covariance))
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = values[order], vectors[:, order]
        self.alive = self.values > _LEAST * self.trace
        self.scaled = self.vectors[:, self.alive] / np.sqrt(self.values[self.alive])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def fit(rows: DataFrame, width: int, most: int = COMPONENTS, tile: int = TILE) -> Fit:
    """A whitening fitted to different vectors, ``rows(x)``."""
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("x", F.abs)))).first()
    wide = 2 * n * largest >= 1 << 62  # beyond, sums are decimals, and products of doubles from the start
    known = rows.agg(*(F.expr(f"sum({f'cast(x[{i}] as decimal(38, 0))' if wide else f'x[{i}]'})") for i in range(width))).first()
    sums = [int(s) for s in known]
    centred = [f"cast(x[{i}] as double) - ({s / n!r}D)" if wide else f"cast({n} * x[{i}] - ({s}) as double) / {n}D" for i, s in enumerate(sums)]
    return Fit(n, sums, pair_sums(rows, centred, tile) / n, wide, most)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _project(fitted: Fit, width: int):
    sums, n = np.array(fitted.sums, object if fitted.wide else np.int64), fitted.n
    out = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                apart = n * _matrix(part.column(1), width).astype(sums.dtype) - sums
                y = np.full((len(apart), out), np.nan)
                y[:, fitted.alive] = (apart / n).astype(np.float64) @ fitted.scaled
                if not fitted.wide and float(np.abs(apart).max(initial=0)) ** 2 * width < 2.0**62:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in apart]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                ends = pa.array(np.arange(len(apart) + 1, dtype=np.int32) * out)
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=np.isnan(y.ravel())))], names=["vec_id", "deviation", "y"])

    return run


def identity_error(projected: DataFrame, fitted: Fit) -> float:
    """The largest entry of the covariance of whitened vectors, ``projected(y)``, minus the identity."""
    alive = np.flatnonzero(fitted.alive)
    if not len(alive):
        return 0.0
    known = projected.agg(F.count("*").alias("n"), *(F.expr(f"avg(y[{i}])") for i in alive)).first()
    cov = pair_sums(projected, [f"y[{i}] - ({mean!r}D)" for i, mean in zip(alive, known[1:])]) / known[0]
    return float(np.abs(cov - np.eye(len(alive))).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component, as the contract of the module says."""
    rows = whole_vectors(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    empty = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not width:
        return empty
    rows = _padded(rows, width)
    different = cut(rows.select("x").distinct())
    fitted = fit(different, width, most, tile)
    project = _project(fitted, width)
    shape = "vec_id long, deviation long, y array<double>"
    error = identity_error(different.select(F.lit(None).cast("long").alias("vec_id"), "x").mapInArrow(project, shape), fitted)
    share = F.array(*map(F.lit, map(float, fitted.explained)))
    out = rows.mapInArrow(project, shape).select("vec_id", "deviation", F.posexplode(F.arrays_zip("y", share.alias("explained"))).alias("k", "c"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", F.col("c.y").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).alias("identity_error")
    )
