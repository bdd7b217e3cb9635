"""Archive members as a stream, each content once, whatever is sent again (ST7, ST8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.readers import unzipped


def archives(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """``path, content, sent`` of new archives below a folder, in the order of their dates."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.schema(shape).format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(path)
    return stream.select("path", "content", F.col("modificationTime").alias("sent"))


def new_archives(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Archives whose digest has not come before (ST8).

    The digests are Spark's keyed state, kept in the stream's checkpoint: an archive that is sent again, in the same
    micro-batch, a later one or after a restart, adds nothing. With ``late``, digests are dropped that long after their
    archive was sent, which bounds the state.
    """
    keyed = stream.withColumn("archive_md5", F.md5("content"))
    return keyed.withWatermark("sent", late).dropDuplicatesWithinWatermark(["archive_md5"]) if late else keyed.dropDuplicates(["archive_md5"])


def new_members(stream: DataFrame, suffix: str = ".avro", late: str | None = None) -> DataFrame:
    """``archive, member, content, md5`` of members whose digest has not come before, in whatever archive."""
    rows = unzipped(stream.select("path", "content", "sent"), suffix)
    return rows.withWatermark("sent", late).dropDuplicatesWithinWatermark(["md5"]) if late else rows.dropDuplicates(["md5"])
