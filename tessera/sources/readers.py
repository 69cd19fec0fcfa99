"""Uploads as DataFrames: delimited text with a sniffed separator, JSON sections, paragraphs; and exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X

# fixed values: accepted kinds of file, and the largest size of one
ALLOWED = {"csv", "tsv", "json", "txt", "pdf", "docx"}
LARGEST = 25 * 1024 * 1024
SEPARATORS = (",", ";", "|", "\t")


def check_upload(name: str, size: int) -> None:
    """Reject files of other kinds, empty ones and too large ones."""
    kind = name.rpartition(".")[2].lower()
    if kind not in ALLOWED:
        raise ValueError(f"files of kind .{kind} aren't accepted")
    if size <= 0:
        raise ValueError("the file is empty")
    if size > LARGEST:
        raise ValueError(f"the file is larger than {LARGEST} bytes")


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most of (ties and none: the comma first)."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0].value[:4096] if head else ""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as strings, named by the header in lower case with _ for spaces; cells made safe.

    Quoted cells may hold line breaks, so a file (an upload of at most LARGEST bytes) is read by one task. A path with
    bytes that aren't UTF-8 is read as Latin-1.
    """
    sep = separator or sniffed_separator(spark, path)
    bad = not spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty()
    df = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE", encoding="ISO-8859-1" if bad else "UTF-8", multiLine=True, escape='"')
    names = [re.sub(r"\s+", "_", c.replace("﻿", "").strip().lower()) for c in df.columns]
    df = df.toDF(*names)
    return df.select(*(F.when(F.trim(c).isin("", "-", "NA", "N/A"), None).otherwise(X.safe_cell(F.col(c))).alias(c) for c in names))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(block, text): paragraphs between blank lines; bytes that aren't UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    blocks = F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n[ \t]*\r?\n"))
    return raw.select("path", blocks.alias("block", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row an object: of an array its elements; of an object all elements of its list members, else itself.

    Columns differ between sections; what one lacks is null. section names the member.
    """
    df = spark.read.json(path, multiLine=True, mode="PERMISSIVE")
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not lists:
        return df
    parts = [df.select(F.explode(name).alias("e")).select("e.*").withColumn("section", F.lit(name)) for name in lists]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def primitives_only(df: DataFrame) -> DataFrame:
    """The table without nested columns."""
    return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; times as ISO text; a file for each partition."""
    shaped = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) else F.col(f.name) for f in df.schema.fields]
    df.select(*shaped).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, key: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet with bounded files, clustered by a key for later lookups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
