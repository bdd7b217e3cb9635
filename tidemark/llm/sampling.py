"""Bounded samples that do not depend on how the rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def smallest_hashes(rows: DataFrame, key: str, limit: int, *ties: Column | str) -> DataFrame:
    """The ``limit`` rows whose keys, with ``ties``, have the smallest hashes; all of them if there are no more.

    A threshold on the hash leaves a few times ``limit`` rows, so what a single task orders does not grow with the
    input. Where rows repeat so often that it leaves too few different ones, it is raised, and repeats are taken once.
    """
    h = F.xxhash64(key, *ties)
    share = 4 * limit / max(1, rows.count())
    found = rows if share >= 1 else rows.distinct()
    while share < 1:
        some = rows.where(h < int(share * 2.0**64) - (1 << 63))
        n = some.agg(F.count("*").alias("rows"), F.countDistinct(h).alias("keys")).first()
        if n.keys >= limit:
            found = some if n.rows <= 4 * n.keys else some.distinct()
            break
        share *= 8
    return found.orderBy(h, key, *ties).limit(limit)
