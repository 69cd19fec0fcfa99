"""Ranked lexical search: postings joined with the items' terms, integer scores summed, a window for the best.

Each document becomes a list of those terms that any item asks for, with their occurrences, and its number of terms.
The table is dealt by document, so the sum over an item's terms in a document needs no second shuffle: a term that
is in most documents lies in all shards, and no task holds its postings whole. Exploded, it is the postings, each with
its term; the items' terms, with their weights, are joined to them by term. A match scores in 64-bit integers, groups
by item and document sum, and row_number over an item keeps the best; Spark applies that limit in each shard first.

The items' terms go to the tasks that read texts only up to VOCABULARY of them, and are broadcast to the join only up to
BROADCAST_ROWS rows; beyond, postings hold every term, and both sides are shuffled by term (with the same result).

Null and empty texts have no terms: such documents are in no result and no count, such items have no results.
Very long texts are read whole. Repeated documents are ranked each by itself; ties go by ascending doc_id (nulls first),
then by the order of rows. Rows that repeat an item_id, or have none, are searched each by itself. Empty tables give an
empty result. Only doc_id, item_id and text are read, whatever the other columns' names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, stored

BEST = 20
VOCABULARY, BROADCAST_ROWS = 200_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes of terms, in lower case, and a space for every other byte.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "row long, doc_id long, n long, terms array<string>, tf array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(LETTERS).split()


def counted_terms(docs: DataFrame, vocabulary: frozenset[bytes] | None) -> DataFrame:
    """COUNTED: a row a document, with the occurrences of each term (of the vocabulary, if one is given)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, row = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            sizes, starts, terms, tf = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text or b"")
                own = Counter(words)
                sizes.append(len(words))
                for t in own if wanted is None else own.keys() & wanted:
                    terms.append(t)
                    tf.append(own[t])
                starts.append(len(terms))
            at = pa.array(starts, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))
            yield pa.record_batch([pa.array(range(row, row + len(b)), pa.int64()), b.column(0), pa.array(sizes, pa.int64()), *lists], names=names)
            row += len(b)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, COUNTED)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of each item; item: a number of its row."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", F.explode(words).alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, vocabulary: int = VOCABULARY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the documents (doc_id, text) that score highest for each item (item_id, text)."""
    spark = docs.sparkSession
    asked = stored(item_terms(items.select("item_id", "text")), "item_terms")
    known = asked.select("term").distinct().limit(vocabulary + 1).toPandas()["term"]
    few = frozenset(t.encode() for t in known) if len(known) <= vocabulary else None
    counted = stored(counted_terms(docs, few), "counted")
    n, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    wanted = stored(asked.join(df, "term").select("item", "item_id", "term", (F.col("times") * weight).alias("w")).where("w > 0"), "wanted")
    m = F.expr(f"100 - 25 + (25 * n * {n}L) div {max(1, total)}L")
    shards = counted.where(F.size("terms") > 0).select("row", "doc_id", m.alias("m"), F.arrays_zip("terms", "tf").alias("p"))
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    postings = shards.select("row", "doc_id", "m", F.inline("p")).withColumnRenamed("terms", "term")
    small = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    matches = postings.join(F.broadcast(wanted) if small else wanted, "term")
    part = F.expr("w * ((1000000000L * tf) div (1000L * tf + 12 * m))")
    scores = matches.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.sum(part).alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    top = scores.where("score > 0").withColumn("rank", place).where(F.col("rank") <= best)
    return top.select("item_id", "rank", "doc_id", "score")


RANKED_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN whole GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id) CROSS JOIN whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {BEST}
"""
