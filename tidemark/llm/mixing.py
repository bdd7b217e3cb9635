"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in a shuffled order and cut into blocks of
``BLOCK`` words. The schedule is a sequence of slots: slot i takes the source into whose
stretch of cumulative weight the golden-ratio point frac((i + 1) / phi) falls. Slots are
ranked within their source; the slot of rank r takes block r modulo the source's blocks. A
document's share is what the slots take of the blocks that it lies in.

The sequence alone says how many slots a source has. Golden-ratio points fall into a stretch
as often as its length says, but for a few, so a source's words miss its target by a few
blocks at most. Slots beyond ``cap`` passes over a source take nothing.

Ranks and offsets are prefix sums over about sqrt(n) groups of about sqrt(n) rows each, so
neither a hot source nor the whole table is ever one window. The sources are a table too.

Defined results: a null or empty text has size 0 and is taken 0 times. Null is a source of
its own, the last. Rows that repeat an id count as documents of their own. Extra columns
do not matter. An empty table gives an empty one. Reruns agree: the shuffled order goes by
hashes, and rows that tie in all that is asked for are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.plans.lineage import cut
from tidemark.plans.rows import packed, unpacked

#: Words in a block.
BLOCK = 32
#: Most sources (a few numbers each) that are broadcast; beyond, rows are shuffled by source.
BROADCAST = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / phi


def golden_points(slots: np.ndarray) -> np.ndarray:
    """frac((i + 1) / phi) of each slot, in whole numbers up to the last step, so that it stays exact for long schedules."""
    return (((slots.astype(np.uint64) + np.uint64(1)) * _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _golden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(golden_points(batch.column(0).to_numpy()))], names=["slot", "point"])


def _small(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _running(table: DataFrame, *columns: str) -> DataFrame:
    """``table``, in its order of partitions and of ``at`` in them, with the sums of ``columns`` over all rows before."""
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(*(F.sum(c).alias(f"all_{c}") for c in columns))
    over = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    parts = cut(parts.select("part", *(F.coalesce(F.sum(f"all_{c}").over(over), F.lit(0)).alias(f"first_{c}") for c in columns)))
    table = table.join(F.broadcast(parts), "part")
    sums = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"first_{c}")).alias(f"before_{c}") for c in columns]
    return table.select(*(c for c in table.columns if not c.startswith("first_")), *sums)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``s, source, n, target, part, at`` for each row of ``sizes(source, n)``: the words to take from each source.

    Sources by code point, null last, weigh as ``weights`` say, repeating; together they take ``share`` of all words.
    Targets stop at ``cap`` times a source's size; what such a source cannot take is shared among the rest by weight,
    until none is above its cap. Each turn raises the words for a unit of weight and is one aggregate over the sources.
    """
    ordered = sizes.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").sortWithinPartitions("none", "source")
    ordered = cut(ordered.select("source", "n", F.monotonically_increasing_id().alias("id"), F.lit(1).alias("one")))
    ordered = ordered.select("source", "n", "one", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"))
    ordered = _running(ordered, "one").withColumnRenamed("before_one", "s").drop("one")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights)).cast("int"))
    ordered = cut(ordered.withColumn("w", weight))
    unit, full = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("w") > F.lit(cap) * F.col("n")
        got = ordered.agg(F.sum("n").alias("n"), F.sum(F.when(over, F.col("n"))).alias("capped"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("full")).first()
        if got.full == full or not got.w:
            break
        full, unit = got.full, (share * got.n - cap * (got.capped or 0)) / got.w
    return ordered.withColumn("target", F.least(F.lit(unit) * F.col("w"), F.lit(cap) * F.col("n"))).drop("w")


def schedule(stretches: DataFrame, total: int) -> DataFrame:
    """``(slot, s, rank)`` of ``total`` slots over ``stretches(s, lo, hi)``, which divide the numbers from 0 to 1."""
    spark = stretches.sparkSession
    cells = max(1, 4 * stretches.count())
    reach = F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))
    touched = _small(cut(stretches.where("lo < hi").select("s", "lo", "hi", F.explode(reach).alias("cell"))))
    points = spark.range(total).select(F.col("id").alias("slot")).mapInArrow(_golden, "slot long, point double")
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    points = points.join(touched, "cell").where("lo <= point and point < hi").select("slot", "s")
    points = points.withColumn("chunk", F.floor(F.col("slot") / max(1, math.isqrt(total))))
    before = points.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = before.select("s", "chunk", (F.sum("n").over(W.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("s", "chunk").orderBy("slot")) - 1
    return points.withColumn("inside", inside).join(before, ["s", "chunk"]).select("slot", "s", (F.col("before") + F.col("inside")).alias("rank"))


def _mix(docs: DataFrame, weights: Sequence[float], share: float, cap: float, block: int) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    base = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))
    base = base.withColumn("row", F.monotonically_increasing_id())
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("n")), weights, share, cap)
    # A pass over a source takes all its blocks, of which the last may be short; the rest of its target ends inside one.
    blocks = F.ceil(F.col("n") / block)
    passes = F.floor(F.col("target") / F.col("n"))
    need = F.when(F.col("n") > 0, passes * blocks + (F.col("target") - passes * F.col("n")) / block).otherwise(F.lit(0.0))
    sources = cut(_running(sources.withColumn("blocks", blocks).withColumn("need", need), "need"))
    total = sources.agg(F.sum("need")).first()[0] or 0.0
    slots = round(total)
    ends = (F.col("before_need") / (total or 1.0), (F.col("before_need") + F.col("need")) / (total or 1.0))
    plan = schedule(sources.select("s", ends[0].alias("lo"), F.when(ends[1] > 1 - 1e-12, 1.0).otherwise(ends[1]).alias("hi")), slots)

    table = _small(sources.select("s", F.col("source").alias("of"), F.col("n").alias("source_size"), "target", "blocks"))
    known = base.join(table, base["source"].eqNullSafe(table["of"])).drop("of")
    cells = max(1, math.isqrt(base.count()))
    placed = known.where("size > 0").select("row", "s", "size", F.xxhash64(F.lit("cell"), "doc_id").alias("h"), "doc_id").withColumn("cell", F.pmod("h", F.lit(cells)))
    totals = placed.groupBy("s", "cell").agg(F.sum("size").alias("n"))
    totals = totals.select("s", "cell", (F.sum("n").over(W.partitionBy("s").orderBy("cell")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("s", "cell").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    offset = placed.withColumn("inside", inside).join(totals, ["s", "cell"]).select("row", "s", "size", (F.col("before") + F.col("inside")).alias("lo"))
    pieces = offset.withColumn("hi", F.col("lo") + F.col("size")).select("row", "s", "lo", "hi", F.posexplode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")).alias("nth", "block"))
    pieces = pieces.select("row", "s", "nth", "block", (F.least("hi", (F.col("block") + 1) * block) - F.greatest("lo", F.col("block") * block)).alias("n"))

    plan = plan.join(table.select("s", "blocks"), "s").where(F.col("rank") < F.floor(F.col("blocks") * F.lit(cap)))
    taking = plan.groupBy("s", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    took = pieces.join(taking, ["s", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).cast("long").alias("taken"), F.max(F.when(F.col("nth") == 0, F.col("times"))).cast("int").alias("times"))
    out = known.join(took, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("times", F.lit(0)).alias("times"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs(doc_id, source, text)``."""
    return _mix(docs.withColumn("doc_id", F.col("doc_id").cast("long")), weights, share, cap, block).drop("times")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the schedule takes the block that its first word lies in.

    Rows go by ``row_key``, so null and repeated ids are documents of their own; rows that are equal in all columns
    come as often as the mix takes them together. Documents without words are in no block and never come.
    """
    rows = packed(docs)
    taken = _mix(rows.select(F.col("key").alias("doc_id"), F.col("row").getField("source").alias("source"), F.col("row").getField("text").alias("text")), weights, share, cap, block)
    times = taken.groupBy(F.col("doc_id").alias("key")).agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    times = cut(times.where("times > 0"))
    joined = rows.join(times.where("rows = 1"), "key")
    equal = times.where("rows > 1")
    if not equal.isEmpty():
        joined = joined.unionByName(rows.join(equal, "key").dropDuplicates(["key"]))
    return unpacked(joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))), docs)
