"""Rows that have no key of their own, and whose columns may have any names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns as text, 128 bits, nulls told from values; the same on every reading, and equal for equal rows.

    Two of n different rows share one with a probability of about n^2 / 2^129. Maps count as their JSON text.
    """
    cells = []
    for f in df.schema:
        c = df[f"`{f.name.replace('`', '``')}`"]
        cells += [c.isNull(), F.to_json(F.struct(c)) if _holds_map(f.dataType) else c]
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *cells)), 16, "0") for seed in ("first", "second")))


def packed(df: DataFrame) -> DataFrame:
    """``key, row``: each row's ``row_key``, and its columns in one, so that no name of theirs clashes with another."""
    columns = [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
    return df.select(row_key(df).alias("key"), F.struct(*columns).alias("row"))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from the ``row`` of each of ``rows``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in like.columns))
