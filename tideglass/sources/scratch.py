"""Tables between the steps of a job, in the folder that driver and executors share: they cut lineage and outlive any executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark deletes what an execution has shuffled when it ends, where else a collection of the driver's garbage has to come first.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without is on the cluster's default file system, which need not be the local one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideglass-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. Its maker may delete it once it is no longer read; else it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tideglass/{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark can write to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, computed once. Its size is that of its files, whatever the plan before it estimated."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def passes(rows: int, rows_a_pass: int, most: int) -> int:
    return max(1, min(most, -(-rows // rows_a_pass)))


def by_passes(spark: SparkSession, n: int, make: Callable[[int], DataFrame], what: str) -> DataFrame:
    """written() of the rows of make(0) to make(n - 1), one after the other in one table: what a pass has shuffled is deleted before the next begins, so that the disk holds an nth of it."""
    path, was = scratch(spark, what), spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        for i in range(n):
            df = make(i)
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of written() that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            delete(spark, path)
