"""Stored intermediate tables: lineage is cut by a Parquet table in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_made: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is named and all runs here."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_own_folder[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def spread(df: DataFrame, tasks_a_core: int = 1) -> DataFrame:
    """The rows over all cores where they come in fewer partitions than there are cores, as from one small file.

    For work that costs more than a shuffle of its input. Larger tables stay as they are read. With more tasks a core, so
    do only tables in that many partitions: for work so costly that a core's share, or a file's part, is too much for one task.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * tasks_a_core
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df.stored_path)


def forget_all(spark: SparkSession) -> None:
    """Delete all tables that this process has stored, once no result is read any more."""
    for path in sorted(_made):
        _delete(spark, path)
