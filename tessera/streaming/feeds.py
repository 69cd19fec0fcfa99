"""Streams into tables: incidents with their nearest zone, and a numbered feed that readers can replay.

Each micro-batch goes to a folder named by its number, so a batch that runs again after a failure replaces itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import places
from tessera.operators.ranking import numbered

#: So many batches' last numbers are kept in an entry, for polls that are close behind.
RING = 100


def _to_folders(stream: DataFrame, path: str, checkpoint: str, change) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        change(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def placed_incidents(stream: DataFrame, zones: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Incidents (incident_id, lat, lng, ...) with the nearest of zones (zone, clat, clng); without a place: null."""

    def change(batch: DataFrame, number: int) -> DataFrame:
        near = places.nearest(batch.select("incident_id", "lat", "lng"), zones, "incident_id", "zone")
        return batch.join(near.select("incident_id", "zone", "distance"), "incident_id", "left")

    return _to_folders(stream, path, checkpoint, change)


def _files(spark: SparkSession, path: str):
    """(file system, its path class) of a folder."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _entries(spark: SparkSession, path: str) -> dict[int, list[list[int]]]:
    """The entries kept: number of a batch -> (batch, last seq) of it and of those before it, latest last."""
    fs, kind = _files(spark, path)
    folder = kind(f"{path}/_published")
    names = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    out = {}
    for name in names:
        if name.getName().isdigit():
            out[int(name.getName())] = json.loads(spark.read.text(name.toString(), wholetext=True).first()[0])
    return out


def _publish(spark: SparkSession, path: str, number: int, ring: list[list[int]]) -> None:
    """Make a batch visible by one rename; entries before the last two are no longer needed."""
    fs, kind = _files(spark, path)
    done, part = kind(f"{path}/_published/{number}"), kind(f"{path}/_published/.{number}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(ring).encode()))
    out.close()
    fs.delete(done, False)
    if not fs.rename(part, done):
        raise OSError(f"batch {number} of {path} could not be published")
    for f in fs.listStatus(kind(f"{path}/_published")):
        if f.getPath().getName().isdigit() and int(f.getPath().getName()) < number - 1:
            fs.delete(f.getPath(), False)


def numbered_feed(stream: DataFrame, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Rows with seq, going on from the batches before; a repeated batch gets the numbers it had.

    A batch reads the entry that the one before it published, not the feed, so its cost doesn't grow with the feed. Its
    rows are visible once its own entry is there; one that failed before is written anew by the restarted stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entries = _entries(spark, path)
        before = entries.get(number - 1, [])
        if number and not before:
            raise ValueError(f"{path} has no entry of batch {number - 1}: the checkpoint is another feed's")
        last = before[-1][1] if before else 0
        folder = f"{path}/batch={number}"
        numbered(batch, order).withColumn("seq", F.col("seq") + F.lit(last)).write.mode("overwrite").parquet(folder)
        upto = spark.read.schema("seq bigint").parquet(folder).agg(F.coalesce(F.max("seq"), F.lit(last))).first()[0]
        _publish(spark, path, number, [*before, [number, upto]][-RING:])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def last_seq(spark: SparkSession, path: str) -> int:
    """The last number published; 0 before the first batch."""
    entries = _entries(spark, path)
    return entries[max(entries)][-1][1] if entries else 0


def poll(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Published rows after `since`, with batch.

    Where the last RING batches hold them all, only the folders of those that do are read; otherwise the whole feed's,
    with the filter on seq pushed to the scan.
    """
    entries = _entries(spark, path)
    if not entries:
        raise ValueError(f"nothing is published in {path}")
    ring = entries[max(entries)]
    newest = ring[-1][0]
    rows = spark.read.parquet(path).where(F.col("batch") <= newest)
    covered = ring[0][0] == 0 or ring[0][1] <= since
    if covered:
        rows = rows.where(F.col("batch") >= next((b for b, upto in ring if upto > since), newest + 1))
    return rows.where(F.col("seq") > since)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All rows written, those of a batch that isn't published yet too."""
    return spark.read.parquet(path)
