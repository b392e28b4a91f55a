"""Cutting the lineage of iterative jobs with tables in the cluster's shared checkpoint folder.

A written table outlives lost executors, and unlike an RDD checkpoint it brings its size along: the optimizer
broadcasts a small one by itself and prunes columns and partitions of a large one.

Tables that a loop has done with are deleted by :func:`release`; those that a returned DataFrame still reads go when
the Python process ends.
"""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or where it is unset a folder in the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; what is written there is deleted at the latest at exit."""
    path = f"{checkpoint_dir(spark)}/halospark-{uuid4().hex}"
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*paths: str) -> None:
    """Delete written tables that no DataFrame in use reads any more."""
    for path in paths:
        spark = _written.pop(path, None)
        if spark is not None:
            _delete(spark, path)


@atexit.register
def _release_all() -> None:
    for path in list(_written):
        try:
            release(path)
        except Exception:  # the session may be gone: its folder is then for its owner to empty
            return


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = new_path(spark)
    # files by the size of a partition, not one for every task and value
    writer = df.write if partition_by is None else df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` that also reports how many rows meet a condition, counted while writing."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, F.count_if(condition).alias("n")))
    return written, seen.get["n"]
