"""What several of the text operators share: Arrow sizes, hashes, names of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.session import reachable
from tessera.storage import forget, stored

__all__ = ["arrow_limits", "components", "forget", "given_first", "local_stars", "mix", "numbers", "plain_names", "schema_of", "stored", "text_or_empty"]

#: Rows and bytes of a batch handed to Python. Long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Keep the batches for Python small, whatever the length of the texts; let workers find the package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between integer ids to as few edges with the same components: each id with its component's smallest."""
    ids, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def plain_names(df: DataFrame, *needed: str) -> DataFrame:
    """The table with every column but the needed ones renamed by its place, so no name can clash; toDF() undoes it."""
    return df.toDF(*(c if c in needed else f"other{i}" for i, c in enumerate(df.columns)))


def given_first(df: DataFrame, column: str) -> DataFrame:
    """The table with this column named `given` and every other one by its place, so no name can clash."""
    return df.toDF(*("given" if c == column else f"other{i}" for i, c in enumerate(df.columns)))


def schema_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))
