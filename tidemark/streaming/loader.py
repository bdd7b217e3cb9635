"""Batch loading as a stream: one file at a time, oldest first, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import ingest
from tidemark.sources.readers import RECORD


def incoming(spark: SparkSession, path: str, fmt: str = "json", files: int = 1) -> DataFrame:
    """Batch records of new files below a folder (ST1, SC9)."""
    return spark.readStream.schema(RECORD).format(fmt).option("maxFilesPerTrigger", files).option("latestFirst", "false").load(path)


def load(stream: DataFrame, ledger: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Flatten each micro-batch, drop repeats in it, give it to ``handle``, and note it in a ledger (ST1, ST7 to ST10).

    A micro-batch that the ledger has is skipped. If a run ends between ``handle`` and the ledger, the batch is handled
    again after a restart, with the same number, so what ``handle`` writes should go by that number. Without ``every``
    the stream ends when all files are loaded; ``stop()`` pauses it between two (ST11).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(ledger).where(F.col("batch") == number).limit(1).count() > 0
        except Exception as e:  # the ledger begins with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = False
        if done:
            return
        items = ingest.first_per_identifier(ingest.flatten(batch))
        handle(items, number)
        items.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("items"), F.lit("COMPLETE").alias("status")).write.mode("append").parquet(ledger)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def usage_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Usage by resource and category in windows of event time, late events up to a bound; an extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "resource_uid", "category").agg(F.count("*").alias("events"))
