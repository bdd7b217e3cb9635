"""Which outputs of optimisation tools are taken (MD4): the tools run elsewhere, their results are rows."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import media


class Stage(NamedTuple):
    """A stage of the pipeline: the filter that files must pass to enter it (see ``media.stage_filter``), and whether it allows lossy steps."""

    rule: dict
    allow_lossy: bool = False


def accepted(files: DataFrame, results: DataFrame, stages: list[Stage], skip_bytes: int = 0) -> DataFrame:
    """``id, bytes, bytes_after, format_after, taken, warnings, skipped`` of each of ``files``.

    ``files`` has id, bytes, width, height, content_type, format, animated and alpha; ``results`` has id, stage and step
    (from 0), ok, bytes, lossy, always, larger and target_format. Steps go in order. Whether a file enters a stage is settled
    by its size and format where the stage begins. An output is taken if the tool ended well and it is no larger, or larger ones
    are allowed, or it is always taken; what isn't taken is a warning. Files of ``skip_bytes`` or less are left alone.
    A file's results are as many as the pipeline has steps.
    """
    step = F.struct("stage", "step", "bytes", "ok", "lossy", "always", "larger", "target_format")
    rows = files.join(results.groupBy("id").agg(F.sort_array(F.collect_list(step)).alias("steps")), "id", "left")
    allowed = F.array(*(F.lit(s.allow_lossy) for s in stages))

    def enters(state: Column, stage: Column) -> Column:
        tests = [(stage == k) & media.stage_filter(s.rule, state["bytes"], F.col("width"), F.col("height"), F.col("content_type"), state["format"], F.col("animated"), F.col("alpha")) for k, s in enumerate(stages)]
        return functools.reduce(lambda a, b: a | b, tests, F.lit(False))

    def take(state: Column, r: Column) -> Column:
        inside = F.when(state["stage"] == r["stage"], state["inside"]).otherwise(enters(state, r["stage"]))
        ran = inside & (~r["lossy"] | F.coalesce(F.get(allowed, r["stage"].cast("int")), F.lit(False)))
        good = ran & F.coalesce(r["ok"], F.lit(False)) & (F.coalesce(r["bytes"], F.lit(0)) > 0)
        taken = F.coalesce(good & (r["always"] | r["larger"] | (r["bytes"] <= state["bytes"])), F.lit(False))
        return F.struct(
            r["stage"].cast("long").alias("stage"),
            inside.alias("inside"),
            F.when(taken, r["bytes"]).otherwise(state["bytes"]).cast("long").alias("bytes"),
            F.when(taken, F.coalesce(r["target_format"], state["format"])).otherwise(state["format"]).alias("format"),
            (state["taken"] + taken.cast("long")).alias("taken"),
            (state["warnings"] + (ran & ~taken).cast("long")).alias("warnings"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("stage"), F.lit(False).alias("inside"), F.col("bytes").cast("long").alias("bytes"), F.col("format").cast("string").alias("format"), zero.alias("taken"), zero.alias("warnings"))
    skipped = F.col("bytes") <= skip_bytes
    done = rows.withColumn("end", F.when(skipped | F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, take)))
    return done.select("id", "bytes", F.col("end.bytes").alias("bytes_after"), F.col("end.format").alias("format_after"), F.col("end.taken").alias("taken"), F.col("end.warnings").alias("warnings"), skipped.alias("skipped"))
