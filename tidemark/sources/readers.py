"""File sources."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.ingest import FIELDS
from tidemark.sources import avro

ITEM = T.StructType([T.StructField("identifier", T.StringType()), *(T.StructField(n, T.StringType()) for n in FIELDS)])
#: Nested batch records; flat ones are ``ITEM``.
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("multimediaItems", T.ArrayType(ITEM))])


def query(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised SQL query over named frames, which it has in braces (SC1, SC2)."""
    return spark.sql(sql, args=args or {}, **views)


def jdbc(spark: SparkSession, url: str, table: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table over JDBC, fetched in blocks (SC1); give partitionColumn, bounds and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options).load()


def batch_records(spark: SparkSession, path: str, fmt: str = avro.FORMAT, nested: bool = True) -> DataFrame:
    """Batch records (SC8), from Avro containers or from another format of the same shape."""
    spark.dataSource.register(avro.AvroContainer)
    return spark.read.format(fmt).schema(RECORD if nested else ITEM).load(path)


def csv_rows(spark: SparkSession, path: str, schema: str, required: int = 0, header: bool = False) -> DataFrame:
    """CSV by position; rows need their first ``required`` fields non-blank (SC11, FL37, SC12, SC28)."""
    df = spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', multiLine=True)
    for c in df.columns[:required]:
        df = df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df


def csv_with_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark goes, empty fields are null, malformed rows are dropped (SC12, SC13, SC16)."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', mode="DROPMALFORMED", emptyValue=None)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``csv_with_header`` drops, as they stand (SC13)."""
    names = spark.read.csv(path, header=True, quote='"', escape='"').columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__line", T.StringType())])
    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', columnNameOfCorruptRecord="__line")
    return df.where(F.col("__line").isNotNull()).withColumnRenamed("__line", "line")


def last_per_file_name(df: DataFrame, order: str) -> DataFrame:
    """The last row of each file name by an order column (SC14)."""
    rest = [c for c in df.columns if c != "filename"]
    return df.groupBy("filename").agg(F.max_by(F.struct(*rest), order).alias("r")).select("filename", "r.*")


def tag_paths(spark: SparkSession, path: str) -> DataFrame:
    """One tag path a line (SC15)."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def size_on_disk(spark: SparkSession, *paths: str) -> DataFrame:
    """Bytes of all files below each folder (AG17)."""
    sizes = [listing(spark, p).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(p).alias("path"), "bytes") for p in paths]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder (SC21, AG17)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def blobs(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> DataFrame:
    """File contents, or a range of them, with digests (SC23, FN19)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.expr(f"substring(content, {start + 1}, {length})") if length is not None else F.expr(f"substring(content, {start + 1})")
    return df.select("path", content.alias("content"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"))


def unzipped(archives: DataFrame, suffix: str = ".avro") -> DataFrame:
    """``archive, member, content, md5``, and ``sent`` if it is there, of the members of archives ``(path, content)``; a frame or a stream."""
    sent = ["sent"] if "sent" in archives.columns else []

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for k, (archive, content) in enumerate(zip(pdf["path"], pdf["content"])):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in sorted(z.namelist()):
                        if n.endswith(suffix):
                            yield pd.DataFrame([(archive, n, z.read(n), *(pdf[c].iloc[k] for c in sent))], columns=["archive", "member", "content", *sent])

    shape = "archive string, member string, content binary" + ", sent timestamp" * len(sent)
    return archives.select("path", "content", *sent).mapInPandas(unpack, shape).withColumn("md5", F.md5("content"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".avro") -> DataFrame:
    """Members of zip archives with their digests (SC10, ST8); each archive is opened in a task, a member at a time."""
    return unzipped(spark.read.format("binaryFile").load(path), suffix)


def rows_of(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A request body as a relation (SC17, SC26)."""
    return spark.createDataFrame([v if isinstance(v, (tuple, dict)) else (v,) for v in values], schema)
