"""The states that uploads and files go through, from their status events in order (ST10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.ordered import fold_states

#: The states of an upload, and the moves that are legal.
UPLOAD = {
    "UNPACKING": ("UNZIPPED", "CORRUPT_AVRO_FILES"),
    "UNZIPPED": ("WAITING_PROCESSING", "COMPLETE", "CORRUPT_AVRO_FILES"),
    "WAITING_PROCESSING": ("LOADING",),
    "LOADING": ("PARTIALLY_COMPLETE", "COMPLETE"),
    "PARTIALLY_COMPLETE": ("LOADING",),
    "COMPLETE": ("LOADING",),
    "CORRUPT_AVRO_FILES": (),
}
#: Those of a file.
FILE = {"QUEUED": ("LOADING",), "LOADING": ("COMPLETE", "STOPPED"), "STOPPED": ("QUEUED",), "COMPLETE": ("QUEUED",), "INVALID": ()}


def transitions(events: DataFrame, key: str, order: list[str], status: str, moves: dict[str, tuple[str, ...]] = UPLOAD) -> DataFrame:
    """``events`` with the state before and after each, and whether the event was rejected.

    A key begins in the first state of ``moves``. An event asks for a state; a move that isn't legal, or to a state that
    isn't known, or to none, is rejected and leaves the state as it is. Events without a key are those of one key.
    """
    states = list(moves)
    number = {s: k for k, s in enumerate(states)}
    legal = {(number[a], b) for a, to in moves.items() for b in to}
    step = lambda s, e: number[e] if (s, e) in legal else s
    rows = fold_states(events, key, order, status, states, step, states[0], ("state_before", "state_after"))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, to in moves.items() for b in to))
    moved = F.coalesce(F.array_contains(allowed, F.concat("state_before", F.lit(">"), F.col(status).cast("string"))), F.lit(False))
    return rows.withColumn("rejected", ~moved)


def final_states(events: DataFrame, key: str, order: list[str], status: str, moves: dict[str, tuple[str, ...]] = UPLOAD) -> DataFrame:
    """``key``, the state that it is in at last, and how many of its events were taken and rejected."""
    rows = transitions(events, key, order, status, moves)
    n = lambda c: F.count_if(c)
    return rows.groupBy(key).agg(F.max_by("state_after", F.struct(*order)).alias("state"), n(~F.col("rejected")).alias("taken"), n(F.col("rejected")).alias("rejected"))
