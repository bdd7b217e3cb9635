"""Reading all hits in pages by a cursor, over a table laid out in their order (SC19, SL3).

A layout is the rows sorted, newest first, and cut into parts of about as many rows, a directory each;
a manifest holds each part's first and last key and its number of rows. A cursor is the key of the last
row that was seen. The next page lies after it: the manifest names the parts that may hold it, and only
these are opened, however far the cursor has come. No page counts rows from the start.

Keys are (newest, tie). Rows that share a key come on one page, so a page holds ``size`` rows or more;
no row is lost or comes twice. Null dates come last. A layout doesn't change: a scroll sees the table as
it was, whatever is written meanwhile.
"""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows of a part.
PART = 100_000


class Cursor(NamedTuple):
    newest: Any
    tie: Any


def _order(newest: str, tie: str) -> list[Column]:
    return [F.col(newest).desc_nulls_last(), F.col(tie).asc_nulls_last()]


def lay_out(df: DataFrame, path: str, newest: str, tie: str, part: int = PART) -> None:
    """Write the layout of ``df`` and its manifest."""
    parts = max(1, -(-df.count() // part))
    rows = df.repartitionByRange(parts, *_order(newest, tie)).sortWithinPartitions(*_order(newest, tie))
    placed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    placed.write.mode("overwrite").partitionBy("__part").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    key = F.struct(F.col(newest).alias("newest"), F.col(tie).alias("tie"))
    ends = _rows(df.sparkSession, path).groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("rows"), F.min_by(key, "__place").alias("first"), F.max_by(key, "__place").alias("last"))
    flat = ends.select("part", "rows", F.col("first.newest").alias("first_newest"), F.col("first.tie").alias("first_tie"), F.col("last.newest").alias("last_newest"), F.col("last.tie").alias("last_tie"))
    flat.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = json.loads(spark.read.text(f"{path}/schema").first().value)
    return spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/rows")


def after(cursor: Cursor | None, newest: str, tie: str) -> Column:
    """Whether a row comes after the cursor's key."""
    if cursor is None:
        return F.lit(True)
    date, rest = F.col(newest), F.col(tie)
    later = F.lit(False) if cursor.tie is None else rest.isNull() | (rest > F.lit(cursor.tie))
    if cursor.newest is None:
        return date.isNull() & later
    return date.isNull() | (date < F.lit(cursor.newest)) | ((date == F.lit(cursor.newest)) & later)


def page(spark: SparkSession, path: str, newest: str, tie: str, size: int, cursor: Cursor | None = None) -> tuple[DataFrame, Cursor | None]:
    """The page after a cursor, and the cursor to go on from; None after the last one."""
    after_it = spark.read.parquet(f"{path}/manifest").where(after(cursor, "last_newest", "last_tie"))
    seen, wanted = 0, []
    for k, r in enumerate(after_it.orderBy("part").limit(size + 1).select("part", "rows").collect()):  # no part is empty, so a page touches no more
        wanted.append(r.part)
        seen += r.rows if k else 0  # of the first, any share may lie before the cursor
        if seen >= size:
            break
    rows = _rows(spark, path).where(F.col("__part").isin(wanted)).where(after(cursor, newest, tie)).drop("__part", "__place")
    keys = rows.select(newest, tie).orderBy(*_order(newest, tie)).limit(size).tail(1)
    if not keys:
        return rows, None
    last = Cursor(*keys[0])
    return rows.where(~after(last, newest, tie)), last
