"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, bpe, chat, langid, licences, neighbours, packing, pii, ranked, simhash, suffix, telephony, vectors
from tessera.llm.common import stored
from tessera.storage import spread


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(telephony.text_media(_documents(spark, sf_dir)), "media")
    return telephony.media_features(media)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_digest(_documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_documents(spark, sf_dir))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_documents(spark, sf_dir))


def op10_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_telephony": op1_telephony,
    "op2_simhash": op2_simhash,
    "op3_licences": op3_licences,
    "op4_bpe": op4_bpe,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_suffix_array": op7_suffix_array,
    "op8_language": op8_language,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_quantised": op10_quantised,
    "op11_cross_polytope": op11_cross_polytope,
    "op12_ranked": op12_ranked,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op5_chat": chat.CHAT_SQL, "op10_quantised": vectors.VECTORS_SQL, "op11_cross_polytope": neighbours.NEIGHBOURS_SQL, "op12_ranked": ranked.RANKED_SQL}
