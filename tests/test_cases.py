import datetime
import json

import pytest

from tessera.sources import cases

FILE = {
    "case_id": "K-1",
    "status": "open",
    "metadata": {"title": "T", "purpose": "P"},
    "entities": [
        {"id": "V1", "type": "person", "alias": "Victim A", "name": "Person 1", "role": "victim"},
        {"id": "PH", "type": "phone", "value": "+91 9", "registered": False, "name": ""},
        {"id": "SO", "type": "social_handle", "role": "own role"},
        {"id": "V1", "type": "person", "name": "again"},
        {"type": "person"},
    ],
    "relationships": [
        {"id": "R1", "from": "V1", "to": "PH", "relationship": "owns", "evidence_type": "observed", "confidence": 1, "time": "Day 9", "source": "FIR 3"},
        {"id": "R2", "from": "V1", "to": "nobody", "relationship": "owns", "evidence_type": "observed", "confidence": 0.5},
        {"id": "R3", "from": "PH", "to": "SO", "relationship": "used", "evidence_type": "inferred", "confidence": 0.25, "time": "2024"},
    ],
    "events": [{"event_id": "E1", "time": "Day 1-14", "entity": "V1", "location": "nowhere", "type": "call", "description": "d" * 200}],
    "sos": {"state": "none"},
    "alerts": [],
}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cases") / "case.json"
    path.write_text(json.dumps(FILE))
    one = [cases.case_files(spark, str(path), f"k{i}", p, "2026-01-01") for i, p in enumerate(("", "x-"))]
    broken = spark.createDataFrame([("bad", "{", "b-", None), ("none", None, None, None), ("list", "[1]", "", None), ("empty", "{}", "", None)], "case_id string, text string, prefix string, day_one date")
    return cases.sections(one[0].union(one[1]).union(broken)).cache()


def test_sections(parts):
    got = [(r.case_id, r.section) for r in parts.collect()]
    assert {c for c, _ in got} == {"k0", "k1"}
    assert {s: got.count(("k0", s)) for _, s in got} == {"metadata": 1, "entities": 5, "relationships": 3, "events": 1, "sos": 1}


def test_case_tables(parts):
    found = cases.entities(parts)
    rows = {r.uid: r for r in found.collect()}
    assert set(rows) == {"V1", "PH", "SO", "x-V1", "x-PH", "x-SO"}
    assert rows["x-V1"].name == "Victim A" and rows["x-V1"].aliases == ["Person 1"]
    assert rows["V1"].attributes == {"role": "Victim", "case_label": "Person 1"}
    assert (rows["PH"].name, rows["PH"].type, rows["PH"].attributes) == ("+91 9", "phone", {"registered": "false"})
    assert (rows["x-SO"].name, rows["x-SO"].type, rows["x-SO"].attributes) == ("x-SO", "social", {"role": "own role"})
    links = [r for r in cases.relationships(parts, found, "EV-K").orderBy("case_id", "rel_id").collect() if r.case_id == "k1"]
    assert [(r.rel_id, r.source, r.target, r.status, r.confidence, r.source_type, r.evidence_ref) for r in links] == [("R1", "x-V1", "x-PH", "OBSERVED", 1.0, "FIR", "EV-K-0001"), ("R3", "x-PH", "x-SO", "INFERRED", 0.25, "Records", "EV-K-0002")]
    assert [r.day for r in links] == [datetime.date(2026, 1, 9), datetime.date(2024, 6, 1)]
    event = next(r for r in cases.events(parts, found, "ev").collect() if r.case_id == "k1")
    assert (event.uid, event.entity, event.location, len(event.title), event.day) == ("ev-E1", "x-V1", None, 180, datetime.date(2026, 1, 1))
