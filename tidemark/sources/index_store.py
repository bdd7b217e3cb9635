"""An index on disk that is updated bucket by bucket and read as a whole (SK7 to SK10).

The rows of the index lie in buckets, each a directory under the folder of the job that wrote it. A
state's manifest says for every bucket which folder holds it, with a digest of its rows. To publish a new state,
its buckets' digests are held against the last manifest's; only buckets that differ are written, to a
new folder, then the new manifest, and last a mark, a file that appears in one rename and makes it the
latest state. A reader sees the old state or the new one, never a mixture; an interrupted job changes nothing.

Buckets go by an expression that keeps together what changes together, such as ranges of ids: an update
of a share of the buckets rewrites that share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from tidemark.plans.lineage import cut

#: Rows of a bucket's file.
FILE_ROWS = 1_000_000


_MANIFEST = "bucket long, folder string, rows long, digest string"
_STATE = "state long, folder string, schema string"


def _state(spark: SparkSession, root: str, state: int | None = None) -> Row | None:
    """The mark of the latest state, or of a state; None where there is none."""
    try:
        marks = spark.read.schema(_STATE).json(f"{root}/states")
        return marks.where(F.lit(state is None) | (F.col("state") == (state or 0))).orderBy(F.desc("state"), "folder").limit(1).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def latest(spark: SparkSession, root: str) -> int:
    """The number of the latest state; 0 before the first."""
    mark = _state(spark, root)
    return mark.state if mark else 0


def manifest(spark: SparkSession, root: str, mark: Row | None) -> DataFrame:
    """``bucket, folder, rows, digest`` of a state; no rows before the first."""
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/{mark.folder}") if mark else spark.createDataFrame([], _MANIFEST)


def read(spark: SparkSession, root: str, state: int | None = None) -> DataFrame | None:
    """The rows of the latest state, or of an earlier one; None before the first."""
    mark = _state(spark, root, state)
    if mark is None:
        return None
    schema = T.StructType.fromJson(json.loads(mark.schema))
    places = [f"{root}/data/{r.folder}/__bucket={r.bucket}" for r in manifest(spark, root, mark).collect()]  # a row a bucket
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def publish(df: DataFrame, root: str, bucket: Column, base: int | None = None) -> dict[str, int]:
    """Make ``df`` the state of the index; how many buckets there are, were written, and have gone.

    ``bucket`` gives a whole number for each row, null is a bucket of its own. Whoever names the state that ``df`` was made
    from as ``base`` gets an error if another one has been published since. What an interrupted job has written lies in
    a folder of its own that no mark names.
    """
    spark, folder = df.sparkSession, uuid.uuid4().hex
    before = _state(spark, root)
    number = before.state if before else 0
    if base is not None and base != number:
        raise RuntimeError(f"the index is at state {number}, not {base}")
    rows = df.withColumn("__bucket", F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))
    cells = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    h1, h2 = F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)
    digest = F.concat_ws(":", F.count("*").cast("string"), F.sum(h1.cast("decimal(38,0)")).cast("string"), F.bit_xor(h2).cast("string"))
    now = rows.groupBy("__bucket").agg(F.count("*").alias("rows"), digest.alias("digest"))
    old = manifest(spark, root, before)
    same = before is not None and df.schema.json() == before.schema
    both = now.withColumnRenamed("__bucket", "bucket").join(old.select("bucket", "folder", F.col("digest").alias("was")), "bucket", "left")
    kept = F.lit(same) & F.col("was").eqNullSafe(F.col("digest"))
    plan = cut(both.select("bucket", F.when(kept, F.col("folder")).otherwise(folder).alias("folder"), "rows", "digest", (~kept).alias("write")))
    parts = F.ceil(F.col("rows") / FILE_ROWS).alias("__parts")  # a large bucket is written by several tasks
    found = rows.withColumn("__hash", h1).join(plan.where("write").select(F.col("bucket").alias("__bucket"), parts), "__bucket")
    found.repartition("__bucket", F.pmod("__hash", "__parts")).drop("__hash", "__parts").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("__bucket").parquet(f"{root}/data/{folder}")
    plan.drop("write").coalesce(1).write.parquet(f"{root}/manifest/{folder}")
    spark.createDataFrame([(number + 1, folder, df.schema.json())], _STATE).coalesce(1).write.mode("append").json(f"{root}/states")
    if _state(spark, root, number + 1).folder != folder:
        raise RuntimeError(f"another has published state {number + 1} at the same time")
    n = plan.agg(F.count("*").alias("buckets"), F.count_if("write").alias("written")).first()
    return {"buckets": n.buckets, "written": n.written, "gone": old.join(plan, "bucket", "left_anti").count()}
