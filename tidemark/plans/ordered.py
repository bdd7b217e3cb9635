"""Work that goes by order within keys, without a task for a key: rows are sorted over all partitions.

A key that holds a third of all rows spans many partitions, each of which works through its own run of
it. What a run must know of the runs before it is put together from a row for each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.plans.lineage import cut


def sorted_runs(df: DataFrame, *order: str | Column, number: str = "__p") -> DataFrame:
    """``df`` in a global order, kept, with the number of each row's partition."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(number, F.spark_partition_id())


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in a global order, from 1: a partition numbers its own rows, from where the ones before it end."""
    runs = sorted_runs(df, *order)
    before, offsets = 0, {}
    for r in runs.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():  # a row a partition
        offsets[r["__p"]], before = before, before + r.n
    if not offsets:
        return runs.drop("__p").withColumn(name, F.lit(0).cast("long"))
    first = F.element_at(F.create_map(*(F.lit(x).cast(t) for p, n in offsets.items() for x, t in ((p, "int"), (n, "long")))), F.col("__p"))
    return runs.withColumn(name, F.row_number().over(W.partitionBy("__p").orderBy(*order)) + first).drop("__p")


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, previous: str) -> DataFrame:
    """``df`` with the ``value`` of the row before in its key as ``previous``, a struct ``(v)``; null for a key's first row.

    Keys equal by their text in ``keys``; null keys are one key.
    """
    runs = sorted_runs(df, *keys, *order)
    within = W.partitionBy("__p", *keys).orderBy(*order)
    rows = runs.withColumn("__prev", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    ends = runs.groupBy("__p", *keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__end"))
    carried = ends.withColumn("__carry", F.lag("__end").over(W.partitionBy(*keys).orderBy("__p"))).drop("__end")  # a row a run
    on = [F.col("r.__p") == F.col("c.__p"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys)]
    both = rows.alias("r").join(carried.where(F.col("__carry").isNotNull()).alias("c"), on, "left")
    return both.select("r.*", F.coalesce("r.__prev", "c.__carry").alias(previous)).drop("__p", "__prev")


def fold_states(df: DataFrame, key: str, order: list[str], event: str, states: list[str], step: Callable[[int, str], int], start: str, out: tuple[str, str]) -> DataFrame:
    """``df`` with the states before and after each row, of an automaton that each key runs through its rows in order.

    ``step(state, event)`` gives the state after; states are numbers in ``states``, a key begins in ``start``. A
    run of rows is a map from each state to another, and maps of runs compose, so only the key that goes over a partition's
    edge needs what lies before: a map for each partition.
    """
    runs = sorted_runs(df, key, *order)
    n, first = len(states), states.index(start)

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's first and last key, and the map of the last one's rows in it."""
        part = head = last = None
        seen = False
        move = list(range(n))
        for batch in batches:
            for p, k, e in zip(*(c.to_pylist() for c in batch.columns)):
                if not seen:
                    part, head, last, seen = p, k, k, True
                elif k != last:
                    last, move = k, list(range(n))
                move = [step(s, e) for s in move]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([last], pa.string()), pa.array([move], pa.list_(pa.int32()))], names=["p", "head", "last", "move"])

    slim = runs.select("__p", F.col(key).cast("string").alias("k"), F.col(event).cast("string").alias("e"))
    edges = slim.mapInArrow(ends_of, "p int, head string, last string, move array<int>").orderBy("p").collect()  # a row a partition
    begins: dict[int, int] = {}
    key_before, state_before = None, first
    for k, r in enumerate(edges):
        goes_on = k > 0 and r.head == key_before
        begins[r.p] = state_before if goes_on else first
        state_before = r.move[state_before if goes_on and r.head == r.last else first]
        key_before = r.last

    fields = runs.drop("__p").schema
    names = runs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen = None, first, False
        for batch in batches:
            k_col, e_col, p_col = (batch.column(names.index(c)).to_pylist() for c in (key, event, "__p"))
            before, after = [], []
            for p, k, e in zip(p_col, k_col, e_col):
                if not seen:
                    state, seen, last = begins[p], True, k
                elif k != last:
                    state, last = first, k
                before.append(states[state])
                state = step(state, None if e is None else str(e))
                after.append(states[state])
            kept = [c for i, c in enumerate(batch.columns) if names[i] != "__p"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*(c for c in names if c != "__p"), *out])

    return runs.mapInArrow(apply, fields.add(out[0], "string").add(out[1], "string"))
