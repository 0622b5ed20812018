"""Session defaults shared by tests and the benchmark, and the folder that jobs share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", cpus: str | int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries assume: UTC, adaptive plans, Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {spark.sparkContext.master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quire-shared")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt out evenly, or by keys, for work that is heavy by row: a small file of many rows is one task's input otherwise.

    The number of partitions is stated, so that adaptive plans don't join them again for having few bytes.  By keys there are a
    few for each core, as tasks are of unequal size then.
    """
    spark = df.sparkSession
    if keys:
        return df.repartition(_several(spark), *keys)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def gather(files: DataFrame) -> DataFrame:
    """The same files in a few tasks for each core, for Python to read: Spark makes a task of 32 small files, and each costs a start of its own.

    The files of a task are read one after the other as before; where there are fewer tasks, nothing changes.
    """
    return files.coalesce(_several(files.sparkSession))


def _several(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
