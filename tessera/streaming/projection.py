"""A graph projection that follows a stream of edge changes, version by version, and results kept for a version.

A change is (rid, src, dst, status, change_no): an insert, or a later state of the same edge such as its rejection. State lies
in BUCKETS buckets by hash: the edges by rid, the adjacency (u, v, n) and the degrees by u. A batch rewrites only the
buckets that its changes touch, into a folder of its own version; the manifest of the version, written last, names the folder
of every bucket. So a reader sees a version old or new as a whole, a batch that failed is written over when it comes again, and
one that is committed changes nothing when it comes again. Results of a version (cached()) are computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
EDGES = "rid long, src string, dst string, status string, change_no long"
PAIRS = "u string, v string, n long"
DEGREES = "uid string, degree long, weighted long"
MANIFEST = "kind string, bucket int, held int"
SCHEMAS = {"edges": EDGES, "pairs": PAIRS, "degrees": DEGREES}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def version(spark: SparkSession, path: str) -> int:
    """The last committed version; 0 before the first."""
    try:
        return spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def _manifest(spark: SparkSession, path: str, number: int) -> dict[tuple[str, int], int]:
    """(kind, bucket) to the version that holds it: at most three times BUCKETS rows."""
    if not number:
        return {}
    return {(r.kind, r.bucket): r.held for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={number}").collect()}


def _read(spark: SparkSession, path: str, held: dict[tuple[str, int], int], kind: str, buckets: set[int] | None = None) -> DataFrame:
    folders = [f"{path}/{kind}/version={n}/bucket={b}" for (k, b), n in sorted(held.items()) if k == kind and (buckets is None or b in buckets)]
    return spark.read.schema(SCHEMAS[kind]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[kind])


def table(spark: SparkSession, path: str, kind: str, number: int | None = None) -> DataFrame:
    """edges, pairs (an adjacency) or degrees of a version (the last one by default)."""
    return _read(spark, path, _manifest(spark, path, version(spark, path) if number is None else number), kind)


def _touched(rows: DataFrame, key: str) -> set[int]:
    return {r.b for r in rows.select(_bucket(key).alias("b")).distinct().collect()}  # at most BUCKETS numbers


def _rewrite(rows: DataFrame, path: str, kind: str, key: str, number: int, touched: set[int], held: dict[tuple[str, int], int]) -> None:
    """Write the touched buckets of a kind in this version's folder; a bucket without rows is held by none."""
    folder = f"{path}/{kind}/version={number}"
    rows.withColumn("bucket", _bucket(key)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
    filled = set()
    if touched:
        filled = {r.bucket for r in rows.sparkSession.read.schema(f"{SCHEMAS[kind]}, bucket int").parquet(folder).select("bucket").distinct().collect()}
    for b in touched:
        held.pop((kind, b), None)
        if b in filled:
            held[kind, b] = number


def apply(changes: DataFrame, path: str, number: int) -> int:
    """Bring the state to version `number` with a batch of changes; returns the version that is committed."""
    spark = changes.sparkSession
    now = version(spark, path)
    if number <= now:
        return now
    held = _manifest(spark, path, now)
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("change_no")))
    last = changes.select("rid", "src", "dst", "status", "change_no").withColumn("place", place).where("place = 1").drop("place").persist()
    touched = _touched(last, "rid")
    had = _read(spark, path, held, "edges", touched)
    newer = last.join(had.select("rid", F.col("change_no").alias("known")), "rid", "left").where("known is null or change_no > known").drop("known")
    newer = newer.persist()
    old = had.join(newer.select("rid"), "rid", "left_semi")
    counts = lambda rows, n: rows.where("status <> 'REJECTED' and src <> dst").select("src", "dst", F.lit(n).cast("long").alias("n"))
    both = counts(old, -1).union(counts(newer, 1))
    delta = both.select(F.col("src").alias("u"), F.col("dst").alias("v"), "n").union(both.select("dst", "src", "n")).groupBy("u", "v").agg(F.sum("n").alias("n")).where("n <> 0").persist()
    near = _touched(delta, "u")
    pairs = _read(spark, path, held, "pairs", near).union(delta).groupBy("u", "v").agg(F.sum("n").alias("n")).where("n > 0")
    edges = had.join(newer.select("rid"), "rid", "left_anti").unionByName(newer)
    after = dict(held)
    _rewrite(edges, path, "edges", "rid", number, touched, after)
    _rewrite(pairs, path, "pairs", "u", number, near, after)
    fresh = _read(spark, path, after, "pairs", near)
    _rewrite(fresh.groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("degree"), F.sum("n").alias("weighted")), path, "degrees", "uid", number, near, after)
    rows = [(k, b, n) for (k, b), n in sorted(after.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    for df in (last, newer, delta):
        df.unpersist()
    return number


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of changes as the version after its number."""
    return stream.writeStream.foreachBatch(lambda batch, number: apply(batch, path, number + 1) and None).option("checkpointLocation", checkpoint).start()


def cached(spark: SparkSession, path: str, name: str, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """compute(pairs, degrees) of the last version, stored with it; read again as long as the version stays."""
    now = version(spark, path)
    folder = f"{path}/results/{name}/version={now}"
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        compute(table(spark, path, "pairs", now), table(spark, path, "degrees", now)).write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)
