"""Ingestion of an upload: ten stages from the check of the file to the refreshed graph, with a job row and a log.

Rows of a delimited or JSON file state facts: each filled pair of columns is an OBSERVED edge. Paragraphs of a text file are
read by the extraction rules and give INFERRED edges. Either kind is deduplicated by the hash of the whole row (or paragraph),
names become entities by kind and normal form, and edges that the graph has already aren't inserted again.
A file that can't be read makes a FAILED job that keeps the error; nothing else of it is stored. Other failures, as
a lost executor, aren't the file's and are raised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, writes
from tessera.sources import readers
from tessera.storage import spread, stored

# fixed values: names that uploads give these columns, in order of preference
SYNONYMS = {
    "person": ("person", "person_name", "name", "subject", "from_person", "caller"),
    "person_b": ("person_b", "to_person", "associate", "callee", "counterpart"),
    "phone": ("phone", "phone_number", "mobile", "msisdn", "number"),
    "location": ("location", "place", "address", "area", "locality"),
    "organization": ("organization", "organisation", "company", "org", "firm"),
    "vehicle": ("vehicle", "vehicle_number", "registration", "vehicle_no"),
    "transaction": ("amount", "transaction_amount", "value", "txn_amount"),
}
RECORD_SYNONYMS = {
    "source_ref": ("source_ref", "fir_id", "record_id", "reference"),
    "occurred_at": ("date", "timestamp", "occurred_at", "datetime"),
}
STAGES = ("validate", "parse", "clean", "normalise", "deduplicate", "extract", "resolve", "relate", "store", "graph")
# fixed values: cells that stand for none, the longest name, the length of a stored paragraph
NO_VALUES = ("-", "NA", "N/A")
LONGEST_NAME, STORED_TEXT = 190, 4_000
#: A canonical column's kind of entity.
KINDS = {c: "person" if c == "person_b" else c for c in SYNONYMS}
JOB = "job_id string, filename string, source_type string, status string, error string, records_received long, records_processed long, duplicates long, entities_extracted long, relationships_created long"
STAGE = "seq int, stage string, status string, n long"


@dataclass
class Ingested:
    """A job's row, its stages (seq, stage, status, n), and what it stores."""

    job: DataFrame
    stages: DataFrame
    records: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None


def _picked(columns: list[str], names: tuple[str, ...], get) -> Column:
    """The first of these columns that is filled, whatever their case and with _ for spaces; get: a name's column."""
    have = {c.lower().replace(" ", "_"): c for c in columns}
    found = [F.trim(get(have[n]).cast("string")) for n in names if n in have]
    return F.coalesce(F.lit(None).cast("string"), *(F.when((c != "") & ~c.isin(*NO_VALUES), c) for c in found))


def known_columns(rows: DataFrame) -> list[str]:
    """The canonical columns of entities that the rows give."""
    have = {c.lower().replace(" ", "_") for c in rows.columns}
    return [name for name, names in SYNONYMS.items() if have & set(names)]


def named(rows: DataFrame) -> DataFrame:
    """Rows with the canonical columns of entities; other columns stay as they are."""
    return rows.withColumns({name: _picked(rows.columns, SYNONYMS[name], lambda c: rows[f"`{c}`"]) for name in known_columns(rows)})


def recorded(rows: DataFrame, key: str, filename: str, known: DataFrame | None) -> DataFrame:
    """(record_key, payload, content_hash, is_duplicate, source_ref, occurred_at) and the entity columns of each row.

    The hash is of the whole row; known: (content_hash) of stored records of the same kind of source.
    """
    content = sorted(c for c in rows.columns if c != key)
    own = rows.select(F.col(f"`{key}`").alias("record_key"), F.struct(*(F.col(f"`{c}`") for c in content)).alias("payload"))
    hashed = writes.deduplicated(own, ["payload"], "record_key", known)
    pick = lambda names: _picked(content, names, lambda c: F.col("payload").getField(c))
    entity = {name: pick(names) for name, names in SYNONYMS.items()}
    entity["transaction"] = F.concat(F.lit("Rs "), entity["transaction"])
    ref, at = F.coalesce(pick(RECORD_SYNONYMS["source_ref"]), F.lit(filename)), T.any_date(pick(RECORD_SYNONYMS["occurred_at"]))
    return hashed.select("record_key", F.to_json("payload").alias("payload"), "content_hash", "is_duplicate", ref.alias("source_ref"), at.alias("occurred_at"), *(c.alias(name) for name, c in entity.items()))


def paragraphs(blocks: DataFrame, filename: str, known: DataFrame | None) -> DataFrame:
    """(record_key, text, content_hash, is_duplicate, source_ref) of blocks (record_key, text)."""
    return writes.deduplicated(blocks.select("record_key", "text"), ["text"], "record_key", known).withColumn("source_ref", F.lit(filename))


#: Ends of an edge by name, before entities are known.
NAMED_EDGE = ("src_type", "src", "dst_type", "dst", "type", "status", "confidence", "source", "occurred_at")


def row_facts(records: DataFrame, source_type: str, filename: str) -> DataFrame:
    """NAMED_EDGE of each filled pair of a record's columns: observations of 0.9."""
    edges = writes.row_edges(records, columns=("occurred_at",), first="CALLED" if source_type == "CDR" else "ASSOCIATED_WITH")
    return edges.select("src_type", "src", "dst_type", "dst", "type", "status", "confidence", F.lit(f"{source_type} upload: {filename}").alias("source"), "occurred_at")


def stated(found: DataFrame, filename: str) -> DataFrame:
    """NAMED_EDGE of the relations that texts (id, text, spans) state: inferred ones, at no time of their own."""
    r = extraction.relations_in(found, kinds=True)
    r = r.select(F.col("source_kind").alias("src_type"), F.col("source").alias("src"), F.col("target_kind").alias("dst_type"), F.col("target").alias("dst"), "type", F.lit("INFERRED").alias("status"), "confidence", F.lit(f"NLP extraction from {filename}").alias("source"), F.lit(None).cast("timestamp").alias("occurred_at"))
    return r.where("src_type <> 'event' and dst_type <> 'event'")


def mentions(records: DataFrame) -> DataFrame:
    """(type, name) of each filled entity column of records."""
    have = [F.struct(F.lit(kind).alias("type"), F.col(c).alias("name")) for c, kind in KINDS.items()]
    return records.select(F.explode(F.array(*have)).alias("m")).select("m.*").where("name is not null")


def linked(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """NAMED_EDGE rows as edges between entities (type, norm, uid), one of equal ones (the most certain), without loops.

    Rows equal by name collapse before they are made normal. Rows that a largest struct is taken of are dealt by their key
    first, so they are sorted once: aggregates of structs sort, and would do so before the shuffle too.
    """
    edges = edges.groupBy(*NAMED_EDGE[:-1]).agg(F.max("occurred_at").alias("occurred_at"))
    for end in ("src", "dst"):
        edges = edges.withColumn(f"{end}_norm", T.normal(F.col(end), F.col(f"{end}_type")))
    key = ["src_type", "src_norm", "dst_type", "dst_norm", "type"]
    edges = edges.repartition(*key).groupBy(*key).agg(F.max(F.struct("confidence", "status", "source", "occurred_at")).alias("b"))
    for end in ("src", "dst"):
        edges = edges.join(entities.select(F.col("type").alias(f"{end}_type"), F.col("norm").alias(f"{end}_norm"), F.col("uid").alias(end)), [f"{end}_type", f"{end}_norm"])
    return edges.where("src <> dst").repartition("src", "dst", "type").groupBy("src", "dst", "type").agg(F.max("b").alias("b")).select("src", "dst", "type", "b.status", "b.confidence", "b.source", "b.occurred_at")


def ingested(rows: DataFrame | None, key: str, known_hashes: DataFrame | None, known_entities: DataFrame, known_edges: DataFrame, job_id: str, source_type: str = "FIR", filename: str = "upload", blocks: DataFrame | None = None, size: int = 0) -> Ingested:
    """The stages over rows with an ordered key, over text blocks (record_key, text), or over both.

    known_hashes: (content_hash) of the source type's records; known_entities: (type, norm, uid); known_edges: (src, dst,
    type, ...) between uids. size: the file's bytes, for the log.
    """
    spark = known_entities.sparkSession
    parts, names, facts = [], [], []
    if rows is not None:
        records = stored(recorded(rows, key, filename, known_hashes), "records")
        fresh = records.where("not is_duplicate")
        names.append(mentions(fresh))
        facts.append(row_facts(fresh, source_type, filename))
        parts.append(records.select("source_ref", "occurred_at", "payload", "content_hash", "is_duplicate"))
    if blocks is not None:
        texts = stored(paragraphs(blocks, filename, known_hashes), "paragraphs")
        fresh = texts.where("not is_duplicate").select(F.col("record_key").alias("id"), "text")
        found = stored(extraction.entities_in(spread(fresh)), "found")
        names.append(extraction.exploded(found, F.col("spans"), "s", "id").where("s.kind <> 'event'").select(F.col("s.kind").alias("type"), F.col("s.text").alias("name")))
        facts.append(stated(found, filename))
        payload = F.to_json(F.struct(F.substring("text", 1, STORED_TEXT).alias("text")))
        parts.append(texts.select("source_ref", F.lit(None).cast("timestamp").alias("occurred_at"), payload.alias("payload"), "content_hash", "is_duplicate"))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(dfs[1])
    records, all_names, all_facts = union(parts), union(names), union(facts)
    known = known_entities.select("type", "norm", "uid")
    entities = stored(writes.upserted_entities(all_names.where(F.length(F.trim("name")).between(1, LONGEST_NAME)), known, "N-"), "mentions")
    edges = linked(all_facts, entities).join(known_edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    edges = stored(edges, "edges")
    received, repeated = records.agg(F.count("*"), F.count_if("is_duplicate")).first()
    resolved, created = entities.agg(F.count("*"), F.count_if("created")).first()
    related = edges.count()
    if not received:
        return failed(spark, job_id, filename, source_type, "No usable records found", size)
    done = received - repeated
    graph = known_edges.count() + related
    log = dict(zip(STAGES, (size, received, received, done, repeated, created, resolved, related, done, graph)))
    stages = spark.createDataFrame([(i, stage, "complete", n) for i, (stage, n) in enumerate(log.items(), 1)], STAGE)
    job = spark.createDataFrame([(job_id, filename, source_type, "COMPLETE", None, received, done, repeated, created, related)], JOB)
    return Ingested(job, stages, records, entities, edges)


def failed(spark: SparkSession, job_id: str, filename: str, source_type: str, error: str, size: int) -> Ingested:
    """A FAILED job that keeps the error; only the check of the file is done."""
    job = spark.createDataFrame([(job_id, filename, source_type, "FAILED", error[:4_000], 0, 0, 0, 0, 0)], JOB)
    return Ingested(job, spark.createDataFrame([(1, "validate", "complete", size), (2, "parse", "failed", 0)], STAGE))


def ingest_file(spark: SparkSession, path: str, size: int, known_hashes: DataFrame | None, known_entities: DataFrame, known_edges: DataFrame, job_id: str, source_type: str = "FIR") -> Ingested:
    """Ingest a delimited, JSON or text upload; one that is refused or can't be parsed makes a FAILED job with the error."""
    filename, rows, blocks = path.rpartition("/")[2], None, None
    try:
        readers.check_upload(path, size)
        kind = path.rpartition(".")[2].lower()
        if kind == "txt":
            blocks = stored(readers.read_text(spark, path).select(F.col("block").alias("record_key"), "text"), "blocks")
        elif kind in ("csv", "tsv", "json"):
            rows = readers.read_json(spark, path) if kind == "json" else readers.read_delimited(spark, path, "\t" if kind == "tsv" else None)
            if "_corrupt_record" in rows.columns:
                raise ValueError("Parse error: the file isn't valid JSON")
            rows = stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "upload")
        else:
            raise ValueError(f"no text is read from files of kind .{kind}")
    except (ValueError, AnalysisException) as error:
        return failed(spark, job_id, filename, source_type, str(error), size)
    return ingested(rows, "row_no", known_hashes, known_entities, known_edges, job_id, source_type, filename, blocks, size)


def narrative_edges(docs: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(id, source, type, target, status, confidence) of the relations that texts (id, text) state, as INFERRED ones.

    With accepted (surface), only those whose ends are both on that list, whatever their case.
    """
    r = extraction.relations_in(extraction.entities_in(docs))
    if accepted is not None:
        low = accepted.select(F.lower("surface").alias("low")).distinct()
        for end in ("source", "target"):
            r = r.join(low.withColumnRenamed("low", f"{end}_low"), F.lower(end) == F.col(f"{end}_low"), "left_semi")
    return r.select("id", "source", "type", "target", F.lit("INFERRED").alias("status"), "confidence")
