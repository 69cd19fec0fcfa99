"""The corpus pipeline: language, near copies, repeated passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again as the next one's documents. All stages but the last keep the columns of documents.

Null texts and texts without a letter go in the first stage. Of equal texts and near copies the smallest doc_id stays;
rows without doc_id stay and are not compared. Rows that repeat a doc_id stay or go together. Very long texts are worked
on whole. Columns beside doc_id, text, lang and n_chars pass through unread, whatever their names; an empty table gives
empty results of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, pii, simhash, suffix
from tessera.llm.common import stored
from tessera.llm.queries import vocabulary

#: A document stays if its language is known and has at least this score.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model finds; it learns from the labelled documents that aren't held out."""
    model = langid.train(docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    return langid.accepted(docs, model, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place has already."""
    return suffix.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    key = spark.conf.get("spark.tessera.pseudonymKey", pii.DEFAULT_KEY)
    return pii.pseudonymised(docs, key, counts=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL expresses none of the stages from the second on.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
