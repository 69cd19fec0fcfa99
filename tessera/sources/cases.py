"""Case files: one JSON object with sections of different layouts, read as VARIANT and told apart by section.

The functions take (case_id, text, prefix, day_one): a row a file. Short ids as V1 recur between files, so every id
gets its case's prefix. A text that isn't JSON, null texts included, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# fixed values: kinds of entities in case files and here; other kinds stay
TYPES = {
    "person": "person", "phone": "phone", "social_handle": "social",
    "vehicle": "vehicle", "transaction": "transaction", "location": "location",
    "event": "event", "case": "case_record",
    "organization": "organization",
}
# fixed values: labels of roles; other roles stay
ROLES = {
    "victim": "Victim",
    "suspect_primary": "Primary Suspect",
    "linked_identity": "Linked Identity",
    "person_of_interest": "Person of Interest",
    "witness": "Witness",
}


def case_files(spark: SparkSession, path: str, case_id: str, prefix: str, day_one: str) -> DataFrame:
    """(case_id, text, prefix, day_one) of a file, an upload of bounded size."""
    return spark.read.text(path, wholetext=True).select(F.lit(case_id).alias("case_id"), F.col("value").alias("text"), F.lit(prefix).alias("prefix"), F.to_date(F.lit(day_one)).alias("day_one"))


def sections(files: DataFrame) -> DataFrame:
    """(case_id, prefix, day_one, section, place, item): each element of a list, each object that is a section by itself."""
    spark = files.sparkSession
    own = files.select("case_id", "prefix", "day_one", F.try_parse_json("text").alias("v"))  # without a filter, which would parse once more
    tops = spark.sql("SELECT case_id, prefix, day_one, s.key AS section, s.value AS item FROM {own}, LATERAL variant_explode(v) AS s WHERE s.key IS NOT NULL", own=own)
    as_list, as_object = F.try_variant_get("item", "$", "array<variant>"), F.try_variant_get("item", "$", "map<string,variant>")
    items = F.coalesce(as_list, F.when(as_object.isNotNull(), F.array("item")))
    return tops.select("case_id", "prefix", "day_one", "section", F.posexplode_outer(items).alias("place", "item")).where("place IS NOT NULL")


def _text(name: str) -> Column:
    """A field as text; null where it is missing or empty."""
    return F.nullif(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))


def _labelled(v: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[v], v)


def _uid(name: str) -> Column:
    return F.concat(F.coalesce("prefix", F.lit("")), _text(name))


def entities(parts: DataFrame) -> DataFrame:
    """(case_id, uid, type, name, aliases, attributes) of sections(); of one uid in a case the first stays."""
    alias, name, role, registered = _text("alias"), _text("name"), _text("role"), _text("registered")
    both = alias.isNotNull() & name.isNotNull()
    pairs = F.array(F.struct(F.lit("role"), _labelled(role, ROLES)), F.struct(F.lit("registered"), registered), F.struct(F.lit("case_label"), F.when(both, name)))
    pairs = F.filter(pairs, lambda p: p["col2"].isNotNull())
    rows = parts.where("section = 'entities'").select("case_id", "place", _uid("id").alias("uid"), _labelled(_text("type"), TYPES).alias("type"), F.coalesce(alias, _text("value"), name, _uid("id")).alias("name"), F.when(both, F.array(name)).otherwise(F.array().cast("array<string>")).alias("aliases"), F.map_from_entries(pairs).alias("attributes"))
    first = F.row_number().over(Window.partitionBy("case_id", "uid").orderBy("place"))
    return rows.where("uid IS NOT NULL").withColumn("n", first).where("n = 1").drop("n", "place")


def _known(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The rows with name_known: the value of a column where it is an entity of the same case.

    Merged by sorting: Spark takes what is read from a variant for far smaller than it is, and would broadcast it.
    """
    own = found.select("case_id", F.col("uid").alias(name), F.col("uid").alias(f"{name}_known"))
    return rows.join(own.hint("merge"), ["case_id", name], "left")


def relationships(parts: DataFrame, found: DataFrame, evidence_prefix: str = "EV") -> DataFrame:
    """(case_id, rel_id, source, target, type, status, confidence, day, time_label, source_ref, source_type, evidence_ref).

    Rows of sections() whose ends are both entities of the case, each with a numbered piece of evidence.
    """
    rows = parts.where("section = 'relationships'").select(
        "case_id", "place", _text("id").alias("rel_id"), _uid("from").alias("source"), _uid("to").alias("target"), _text("relationship").alias("type"),
        F.when(_text("evidence_type") == "observed", "OBSERVED").otherwise("INFERRED").alias("status"), F.try_variant_get("item", "$.confidence", "double").alias("confidence"),
        T.day_label(F.coalesce(_text("time"), F.lit("")), F.col("day_one")).alias("day"), _text("time").alias("time_label"), F.coalesce(_text("source"), F.lit("Case file")).alias("source_ref"),
    )
    rows = _known(_known(rows, found, "source"), found, "target").where("source_known IS NOT NULL AND target_known IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("place"))  # a case is one bounded file
    kind = F.when(F.col("source_ref").contains("FIR"), "FIR").otherwise("Records")
    ref = F.format_string(f"{evidence_prefix}-%04d", n)
    return rows.select("case_id", "rel_id", "source", "target", "type", "status", "confidence", "day", "time_label", "source_ref", kind.alias("source_type"), ref.alias("evidence_ref"))


def events(parts: DataFrame, found: DataFrame, event_prefix: str) -> DataFrame:
    """(case_id, uid, type, title, description, day, time_label, entity, location); unknown entities and places are null."""
    rows = parts.where("section = 'events'").select(
        "case_id", F.concat(F.lit(f"{event_prefix}-"), _text("event_id")).alias("uid"), _text("type").alias("type"), F.substring(_text("description"), 1, 180).alias("title"), _text("description").alias("description"),
        T.day_label(F.coalesce(_text("time"), F.lit("")), F.col("day_one")).alias("day"), _text("time").alias("time_label"), _uid("entity").alias("entity"), _uid("location").alias("location"),
    )
    rows = _known(_known(rows, found, "entity"), found, "location")
    return rows.select("case_id", "uid", "type", "title", "description", "day", "time_label", F.col("entity_known").alias("entity"), F.col("location_known").alias("location"))
