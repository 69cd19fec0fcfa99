"""The ingestion of uploads: outcomes, stages, second uploads, bytes that aren't UTF-8, quoted line breaks."""

import os

import pytest

from tessera.sources import ingestion

EDGES = "src string, dst string, type string"


@pytest.fixture
def nothing_known(spark):
    return spark.createDataFrame([], "type string, norm string, uid string"), spark.createDataFrame([], EDGES)


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path), os.path.getsize(path)


def ingest(spark, where, known, hashes=None):
    return ingestion.ingest_file(spark, *where, hashes, *known, "J1")


def stages(out):
    return {r.stage: r.n for r in out.stages.collect()}


def test_upload_twice(spark, tmp_path, nothing_known):
    text = 'Person,to person,phone,location,date,FIR_ID,amount\nRahul Sharma,A. Verma,98765 43210,"North\nGate",2024-01-02,F-1,\nA. Verma,,,North Gate,2024-01-03,,500\nA. Verma,,,North Gate,2024-01-04,,N/A\n'
    where = put(tmp_path, "calls.csv", text.encode())
    first = ingest(spark, where, nothing_known)
    job = first.job.collect()[0]
    assert (job.status, job.filename, job.records_received, job.records_processed, job.duplicates, job.entities_extracted, job.relationships_created) == ("COMPLETE", "calls.csv", 3, 3, 0, 5, 5)
    assert list(stages(first).items()) == [("validate", len(text)), ("parse", 3), ("clean", 3), ("normalise", 3), ("deduplicate", 0), ("extract", 5), ("resolve", 5), ("relate", 5), ("store", 3), ("graph", 5)]
    assert sorted((r.source_ref, str(r.occurred_at)[:10]) for r in first.records.collect()) == [("F-1", "2024-01-02"), ("calls.csv", "2024-01-03"), ("calls.csv", "2024-01-04")]
    assert "Rs 500" in {r.norm.replace("rs500", "Rs 500") for r in first.entities.collect()}
    known = first.entities.select("type", "norm", "uid"), first.edges
    again = ingest(spark, where, known, first.records.select("content_hash"))
    assert stages(again)["deduplicate"] == 3 and stages(again)["extract"] == 0 and stages(again)["relate"] == 0 and stages(again)["graph"] == 5


def test_rows_that_differ_in_any_column_are_records(spark, nothing_known):
    rows = spark.createDataFrame([(1, "A B", "Kota", "2024-01-01", "x"), (2, "A B", "Kota", "2024-01-02", "x"), (3, "A B", "Kota", "2024-01-02", "x"), (4, "A B", "Kota", "2024-01-02", None)], "k int, name string, place string, date string, note string")
    out = ingestion.ingested(rows, "k", None, *nothing_known, "J1", "CDR", "f.csv")
    assert stages(out)["deduplicate"] == 1 and stages(out)["relate"] == 1
    edge = out.edges.collect()[0]
    assert (edge.type, edge.status, edge.confidence, edge.source, str(edge.occurred_at)[:10]) == ("VISITED", "OBSERVED", 0.9, "CDR upload: f.csv", "2024-01-02")


def test_synonyms_and_call_records(spark, tmp_path, nothing_known):
    out = ingestion.ingest_file(spark, *put(tmp_path, "list.csv", "from_person;to_person;Number;Locality;firm;vehicle_no\nJosé Núñez;B C;-;Málaga;Acme;DL 8C AA 1234\n".encode("latin-1")), None, *nothing_known, "J1", "CDR")
    assert {(r.type, r.norm) for r in out.entities.collect()} == {("person", "josé núñez"), ("person", "b c"), ("location", "málaga"), ("organization", "acme"), ("vehicle", "DL8CAA1234")}
    assert sorted(r.type for r in out.edges.collect()) == ["ASSOCIATED_WITH", "CALLED", "OWNED", "VISITED"]


def test_text_upload(spark, tmp_path, nothing_known):
    text = "Mr Rahul Sharma met Mrs Meera Verma near the gate.\n\nMr Rahul Sharma transferred Rs 5,000 to Shivam Traders on 10 January 2024.\n\nMr Rahul Sharma met Mrs Meera Verma near the gate.\n"
    out = ingest(spark, put(tmp_path, "note.txt", text.encode()), nothing_known)
    log = stages(out)
    assert (log["parse"], log["deduplicate"], log["store"], log["relate"]) == (3, 1, 2, 3)
    assert {(r.type, r.status, r.source) for r in out.edges.collect()} == {("MET", "INFERRED", "NLP extraction from note.txt"), ("TRANSFERRED_MONEY", "INFERRED", "NLP extraction from note.txt")}
    assert all(r.source_ref == "note.txt" and '"text"' in r.payload for r in out.records.collect())
    assert "event" not in {r.type for r in out.entities.collect()}


def test_failed_jobs_keep_the_error(spark, tmp_path, nothing_known):
    cases = (("virus.exe", b"x", "exe"), ("blank.csv", b"", "empty"), ("head.csv", b"person,phone\n", "No usable"), ("bad.json", b"[{]", "JSON"), ("gaps.txt", b" \n\n ", "No usable"), ("scan.pdf", b"%PDF", "pdf"))
    for name, data, said in cases:
        out = ingest(spark, put(tmp_path, name, data), nothing_known)
        job = out.job.collect()[0]
        assert job.status == "FAILED" and said in job.error and out.records is None, name


def test_rows_without_entities_are_stored(spark, tmp_path, nothing_known):
    out = ingest(spark, put(tmp_path, "other.csv", b"foo,bar\n1,2\n"), nothing_known)
    assert out.job.collect()[0].records_processed == 1 and out.entities.count() == 0


def test_other_failures_are_raised(spark, tmp_path, nothing_known, monkeypatch):
    def lost(*_):
        raise RuntimeError("an executor is lost")

    monkeypatch.setattr(ingestion.readers, "read_delimited", lost)
    with pytest.raises(RuntimeError):
        ingest(spark, put(tmp_path, "a.csv", b"person\nx\n"), nothing_known)


def test_narrative_edges_and_accept_list(spark):
    docs = spark.createDataFrame([(1, "On Monday Rahul Sharma transferred Rs 50,000 to Meera Verma at North Gate."), (2, None)], "id int, text string")
    rows = ingestion.narrative_edges(docs).collect()
    assert rows and all(r.status == "INFERRED" and 0 < r.confidence <= 0.95 for r in rows)
    ends = [(x,) for r in rows for x in (r.source.upper(), r.target.upper())]
    assert ingestion.narrative_edges(docs, spark.createDataFrame(ends, "surface string")).count() == len(rows)
    assert ingestion.narrative_edges(docs, spark.createDataFrame([("nobody",)], "surface string")).count() == 0
