"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and Spark runs in one process (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        return current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if current.isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder, and forget its lineage.

    Each partition is a file there. Whoever knows how many rows there are gives ``parts``, so that a small frame that
    comes out of a wide shuffle is a few files, without another shuffle.
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def parts_for(rows: int, each: int) -> int:
    """How many partitions hold ``rows``, ``each`` at most, on a cluster of any size a few at least."""
    return max(8, -(-rows // each))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
