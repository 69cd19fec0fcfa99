"""Ranks and numbers over whole tables without a single sorting task.

Rows are dealt by ranges of the order and stored with the number of their range; the sizes of ranges, a row each,
are added up, and places within a range come from a window over that range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Stored, so that both uses see the same ranges, also after an executor is lost."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")


def _before(ranged: DataFrame, size) -> DataFrame:
    """(part, before, total): the sum of sizes in the ranges before, and in all."""
    sizes = ranged.groupBy("part").agg(size.alias("size"))
    upto = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(upto, F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))


def numbered(rows: DataFrame, order: list, name: str = "seq") -> DataFrame:
    """Rows with a gapless number from 1 in order."""
    ranged = _ranged(rows, order)
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = ranged.withColumn("own", own).join(F.broadcast(_before(ranged, F.count("*"))), "part")  # a row a partition
    return out.withColumn(name, F.col("before") + F.col("own")).drop("part", "own", "before", "total")


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """The share of rows of strictly smaller value. Counts by value come first, so only distinct values are ranked."""
    ranged = _ranged(df.groupBy(F.col(value).alias("ranked")).agg(F.count("*").alias("same")), ["ranked"])
    upto = F.sum("same").over(Window.partitionBy("part").orderBy("ranked").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranged.withColumn("own", F.coalesce(upto, F.lit(0))).join(F.broadcast(_before(ranged, F.sum("same"))), "part")  # a row a partition
    ranks = ranks.select("ranked", ((F.col("before") + F.col("own")) / F.col("total")).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("ranked")), "left").drop("ranked")
