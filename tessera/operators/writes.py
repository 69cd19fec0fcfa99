"""Writes as functions from tables to tables: the caller stores the result, so a failed job changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ranking import numbered


def deduplicated(rows: DataFrame, columns: list[str], order: str, stored: DataFrame | None = None) -> DataFrame:
    """Rows with content_hash and is_duplicate: not the first of their hash by order, or already stored (content_hash)."""
    hashed = rows.withColumn("content_hash", T.content_hash(*(F.col(c) for c in sorted(columns))))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("first"))
    if stored is not None:
        first = first.join(stored.select("content_hash", F.lit(True).alias("known")).distinct(), "content_hash", "left")
    else:
        first = first.withColumn("known", F.lit(None).cast("boolean"))
    out = hashed.join(first, "content_hash")
    return out.withColumn("is_duplicate", (F.col(order) != F.col("first")) | F.coalesce("known", F.lit(False))).drop("first", "known")


def upserted_entities(mentions: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """(type, norm, uid, created) of mentions (type, name): known (type, norm, uid) ones, else new ids by norm's hash.

    An id from a hash needs no counter and no order over all mentions. A name is made normal once for all its mentions.
    """
    own = mentions.select("type", "name").distinct().select("type", T.normal(F.col("name"), F.col("type")).alias("norm")).where("norm <> ''").distinct()
    out = own.join(known.select("type", "norm", F.col("uid").alias("old")), ["type", "norm"], "left")
    new = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", "type", "norm"), 256), 1, 16))
    return out.select("type", "norm", F.coalesce("old", new).alias("uid"), F.col("old").isNull().alias("created"))


#: A row's pairs of columns, the kinds of their entities, and the relation between them.
ROW_RELATIONS = (
    ("person", "person_b", "person", "ASSOCIATED_WITH"),
    ("person", "phone", "phone", "OWNED"),
    ("person", "location", "location", "VISITED"),
    ("person", "organization", "organization", "ASSOCIATED_WITH"),
    ("person", "vehicle", "vehicle", "OWNED"),
    ("person", "transaction", "transaction", "TRANSFERRED_MONEY"),
)


def row_edges(rows: DataFrame, status: str = "OBSERVED", confidence: float = 0.9, columns: tuple[str, ...] = (), first: str = "ASSOCIATED_WITH") -> DataFrame:
    """(src_type, src, dst_type, dst, type, status, confidence) and columns of each filled pair of a row, without loops.

    first: the relation between two persons of a row.
    """
    have = [(a, b, kind, first if b == "person_b" else t) for a, b, kind, t in ROW_RELATIONS if a in rows.columns and b in rows.columns]
    edges = F.array(*(F.struct(F.lit("person").alias("src_type"), F.col(a).alias("src"), F.lit(kind).alias("dst_type"), F.col(b).alias("dst"), F.lit(t).alias("type")) for a, b, kind, t in have))
    out = rows.select(F.explode(edges).alias("e"), *columns).select("e.*", *columns).where("src is not null and dst is not null and src <> dst")
    return out.withColumns({"status": F.lit(status), "confidence": F.lit(confidence)})


def inserted_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those new ones whose (src, dst, type) isn't there; the most certain of equal new ones."""
    key = ["src", "dst", "type"]
    best = new.groupBy(*key).agg(F.max(F.struct("confidence", "status")).alias("b")).select(*key, "b.status", "b.confidence")
    return edges.select(*key, "status", "confidence").union(best.join(edges, key, "left_anti").select(*key, "status", "confidence"))


def decided(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows with the status of their last decision (key, status, decided_at)."""
    last = decisions.groupBy(key).agg(F.max(F.struct("decided_at", "status")).alias("d")).select(key, F.col("d.status").alias("new_status"))
    out = rows.join(last, key, "left")
    return out.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def removed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


#: Rows that a task looks for keys in, so that its memory stays the same for a larger table.
TASK_ROWS = 500_000


def unmatched(rows: DataFrame, wanted: Column, known: Column, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """The different keys of rows that are wanted and that no known row has (wanted, known: conditions on rows).

    Both kinds are dealt by their key in one shuffle, over as many tasks as the rows ask for, and marked in an aggregate:
    nothing is sorted or collapsed before. A key with a null equals none, as in NOT EXISTS.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    both = rows.where(wanted | known).select(*on, wanted.alias("wanted"), known.alias("known")).repartition(tasks, *on)
    marked = both.groupBy(*on).agg(F.bool_or("wanted").alias("wanted"), F.bool_or("known").alias("known"))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    return marked.where(F.col("wanted") & ~(F.coalesce("known", F.lit(False)) & whole)).select(*on)


def replaced(rows: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Delete by key set, then insert: all rows of keys that the new rows have give way to them."""
    return rows.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def idempotent_insert(rows: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return rows.unionByName(new.dropDuplicates(on).join(rows, on, "left_anti"))


def conjunction(conditions: list[Column | None]) -> Column:
    """Of the conditions that are set, all; without any, true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def allocated(rows: DataFrame, last: int, order: list[str], pattern: str = "REL-%06d") -> DataFrame:
    """Rows with ref, numbered on from the last one in order; no task sorts or counts all rows."""
    return numbered(rows, order, "n").withColumn("ref", F.format_string(pattern, F.col("n") + F.lit(last))).drop("n")
