"""Merging a batch into a table, item after item in order of arrival, as one aggregation for each key.

The reference is a loop: every item finds the row of its key, sets fields that differ, and counts as an
update if one did; the first item of an unknown key makes the row. What the row holds in the end, and
which items changed it, needs no loop: a field's last value is a maximum by order, and an item changed
a field if the value before it, in its key's order, was another.

Null keys are one key. Items that arrive at one time go by their fields. A hot key meets only
aggregates with map-side combine and runs of sorted rows (``plans.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.lineage import cut
from tidemark.plans.ordered import with_previous


def _key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys))


def _is_set(field: str) -> Column:
    return F.col(field).isNotNull() & (F.col(field).cast("string") != "")


def merge_in_order(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, fields: list[str], blanks: str = "overwrite") -> DataFrame:
    """``current`` after the items of ``incoming``, with ``items``, ``updates`` and ``outcome`` (MU1, MU5, MU6, JN21).

    With ``blanks="overwrite"`` each item sets all ``fields``, nulls and blanks too (a batch); with ``"skip"`` only those
    that hold a value (a single update). ``updates`` counts the items that changed a field; the item that makes a row
    doesn't. ``outcome`` is kept, unchanged, updated or new. Other columns of a new row are null. Rows of ``current``
    that repeat a key are all updated, and count by the smallest of them.
    """
    fields = [f for f in fields if f in current.columns]
    at = F.struct(F.col(order).alias("at"), F.to_json(F.struct(*fields)).alias("by"))
    items = cut(incoming.select(_key(keys).alias("__k"), at.alias("__at"), *keys, *fields))
    if blanks == "overwrite":
        last = [F.max_by(F.struct(*fields), "__at").alias("__last")]
        ends = items.groupBy("__k").agg(F.count("*").alias("items"), F.min(F.struct(*keys)).alias("__keys"), *last).select("__k", "items", "__keys", *(F.col(f"__last.{f}").alias(f"__{f}") for f in fields))
        taken = {f: (F.col("items").isNotNull(), F.col(f"__{f}")) for f in fields}
    else:
        last = [F.max_by(F.when(_is_set(f), F.struct(F.col(f).alias("v"))), F.when(_is_set(f), F.col("__at"))).alias(f"__{f}") for f in fields]
        ends = items.groupBy("__k").agg(F.count("*").alias("items"), F.min(F.struct(*keys)).alias("__keys"), *last)
        taken = {f: (F.col(f"__{f}").isNotNull(), F.col(f"__{f}.v")) for f in fields}
    ends = cut(ends)
    known = current.withColumn("__k", _key(keys))
    changes = _changes(known, items, fields, blanks)
    ends = ends.join(changes, "__k", "left").withColumn("updates", F.coalesce("updates", F.lit(0).cast("long")))
    old = known.join(ends, "__k", "left")
    outcome = F.when(F.col("items").isNull(), "kept").when(F.col("updates") > 0, "updated").otherwise("unchanged")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("items", "updates")]
    merged = old.select(*(F.when(taken[c][0], taken[c][1]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in current.columns), *counts, outcome.alias("outcome"))
    fresh = ends.join(known.select("__k"), "__k", "left_anti")
    made = {k: F.col(f"__keys.{k}") for k in keys} | {f: v for f, (_, v) in taken.items()}
    rows = fresh.select(*(made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema), *counts, F.lit("new").alias("outcome"))
    return merged.unionByName(rows)


def _changes(known: DataFrame, items: DataFrame, fields: list[str], blanks: str) -> DataFrame:
    """``__k, updates``: how many items of each key changed something, one after another."""
    base = known.join(items.select("__k").distinct(), "__k", "left_semi").groupBy("__k").agg(F.min(F.struct(*fields)).alias("__r")).select("__k", *(F.col(f"__r.{f}").alias(f) for f in fields))
    first = items.join(known.select("__k"), "__k", "left_anti").groupBy("__k").agg(F.min_by(F.struct(*fields), "__at").alias("__r")).select("__k", *(F.col(f"__r.{f}").alias(f) for f in fields))
    before = base.unionByName(first).withColumn("__at", F.lit(None).cast(items.schema["__at"].dataType)).withColumn("__item", F.lit(False))
    rows = before.unionByName(items.drop(*(set(items.columns) - {"__k", "__at", *fields})).withColumn("__item", F.lit(True)))
    text = lambda f: F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit(""))
    if blanks == "overwrite":
        each = rows.select("__k", F.lit("").alias("__f"), "__item", "__at", F.sha2(F.to_json(F.array(*map(text, fields))), 256).alias("__v"))
    else:
        cells = F.filter(F.array(*(F.struct(F.lit(f).alias("__f"), text(f).alias("__v"), (~F.col("__item") | _is_set(f)).alias("counts")) for f in fields)), lambda c: c["counts"])
        each = rows.select("__k", "__item", "__at", F.inline(cells)).drop("counts")
    with_before = with_previous(each, ["__k", "__f"], ["__item", "__at"], "__v", "__old")
    changed = with_before.where(F.col("__item") & ~F.col("__old.v").eqNullSafe(F.col("__v")))
    return changed.select("__k", "__at").distinct().groupBy("__k").agg(F.count("*").alias("updates")) if blanks == "skip" else changed.groupBy("__k").agg(F.count("*").alias("updates"))


def upsert(current: DataFrame, incoming: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Rows by key; the last incoming one of a key, by ``order`` or else by its columns, replaces those it matches (MU9, MU10, SK7, JN21)."""
    new = _one_each(incoming, list(keys), F.max_by, order, current.columns)
    return _without(current, new, list(keys)).unionByName(new.select(current.columns))


def insert_missing(current: DataFrame, defaults: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Rows of ``defaults`` whose key is not there yet are added, the first of each key (MU18, FL35)."""
    new = _one_each(defaults, list(keys), F.min_by, order, current.columns)
    return current.unionByName(_without(new, current, list(keys)).select(current.columns))


def _one_each(rows: DataFrame, keys: list[str], pick, order: str | None, columns: list[str]) -> DataFrame:
    content = F.struct(*columns)
    by = F.struct(*([F.col(order).alias("__order")] if order else []), F.to_json(content).alias("__by"))
    return rows.groupBy(_key(keys).alias("__k")).agg(pick(content, by).alias("__r")).select("__r.*")


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the others don't have; null keys are equal."""
    return rows.withColumn("__k", _key(keys)).join(others.select(_key(keys).alias("__k")).distinct(), "__k", "left_anti").drop("__k")
