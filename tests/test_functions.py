import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import text as X
from tessera.operators import extraction, patterns, places, resolution, writes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normal_forms(spark):
    lit = F.lit
    assert value(spark, X.normal_phone(lit("+91 98765 43210"))) == "9876543210"
    assert value(spark, X.normal_phone(lit("098765-43210"))) == "9876543210"
    assert value(spark, X.normal_vehicle(lit("DL 8C AA 1234"))) == value(spark, X.normal_vehicle(lit("dl-8c-aa-1234"))) == "DL8CAA1234"
    assert value(spark, X.normal_name(lit("  Shivam   Logistics Ltd. "))) == "shivam logistics ltd"
    assert [value(spark, X.safe_cell(lit(v))) for v in ("=1+1", "@x", "plain", " -2")] == ["'=1+1", "'@x", "plain", "'-2"]
    assert value(spark, X.first_filled(lit("-"), lit("N/A"), lit(" x "))) == "x"


def test_dates(spark):
    for s in ("2024-03-05", "05/03/2024", "05-03-2024", "05 Mar 2024", "2024-03-05 00:00:00"):
        assert value(spark, X.any_date(F.lit(s))) == datetime.datetime(2024, 3, 5)
    assert value(spark, X.any_date(F.lit("soon"))) is None
    anchor = F.lit("2024-01-01").cast("date")
    assert value(spark, X.day_label(F.lit("Day 9"), anchor)) == datetime.date(2024, 1, 9)
    assert value(spark, X.day_label(F.lit("Day 1-14"), anchor)) == datetime.date(2024, 1, 1)
    assert value(spark, X.day_label(F.lit("2023"), anchor)) == datetime.date(2023, 6, 1)
    assert value(spark, X.day_label(F.lit("later"), anchor)) is None


def test_similarity(spark):
    sound = lambda s: value(spark, X.sound(F.lit(s)))
    assert sound("Sharma") == sound("Sharmaa") and sound("Ashcraft") == "A261" and sound("Tymczak") == "T522" and sound("12") == ""
    jw = lambda a, b: value(spark, X.jaro_winkler(F.lit(a), F.lit(b)))
    assert jw("verma", "verna") > 0.85 and jw("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and jw("abcdxx", "abzzyy") == pytest.approx(0.6444, abs=1e-4)
    assert jw("", "a") == 0 and jw("a", "a") == 1
    assert value(spark, X.edit_ratio(F.lit(""), F.lit(""))) == 1 and value(spark, X.edit_ratio(F.lit("abcd"), F.lit("abxd"))) == 0.75
    short = lambda a, b: value(spark, X.is_abbreviation(F.lit(a), F.lit(b)))
    assert short("R. Sharma", "Rahul Sharma") and short("Rahul S.", "Rahul Sharma") and not short("A. Verma", "Rahul Sharma") and not short("Rahul Sharma", "Rahul Sharma")
    assert short("R.S.", "Rahul Sharma") and short("Sharma", "Rahul Sharma") and not short("Rahul Sharma", "R. Sharma") and not short("Rahul Sharma", "Rahul  Sharma")


def test_places(spark):
    km = value(spark, geo.haversine(F.lit(28.70), F.lit(77.10), F.lit(28.52), F.lit(77.10)))
    assert 19 < km < 21
    points = spark.createDataFrame([(1, 28.5, 77.0), (2, -89.9, 10.0), (3, None, 1.0), (4, 0.0, 179.9)], "id int, lat double, lng double")
    centres = spark.createDataFrame([(1, 28.51, 77.0), (2, 28.49, 77.01), (3, -80.0, -170.0)], "c int, clat double, clng double")
    near = {r.id: r.c for r in places.nearest(points, centres, "id", "c").collect()}
    assert near[1] == 1 and near[2] == 3 and 3 not in near and 4 in near
    inside = places.within(points, centres, F.lit(2.0)).select("id", "c").collect()
    assert {(r.id, r.c) for r in inside} == {(1, 1), (1, 2)}


def records(spark):
    rows = [
        ("a", "person", "Rahul Sharma", [], {"id_proof": "X1", "vehicle": "DL1"}, ["n1"], []),
        ("b", "person", "R. Verma", [], {"id_proof": "X1", "vehicle": "DL1"}, ["n1", "n2"], ["c1"]),
        ("c", "person", "Anil Kumar", [], {}, [], []),
        ("d", "person", "Anil Kumar", [], {}, [], []),
        ("e", "person", "Zed Quill", [], {"phone": "9"}, [], []),
    ]
    return spark.createDataFrame(rows, "uid string, type string, name string, aliases array<string>, attributes map<string,string>, neighbours array<string>, cases array<string>")


def test_resolution(spark):
    r = records(spark)
    pairs = resolution.candidate_pairs(r)
    assert {("a", "b"), ("c", "d")} <= {(p.a, p.b) for p in pairs.collect()}
    got = {(p.a, p.b): p for p in resolution.score_pairs(r, pairs).collect()}
    assert got["a", "b"].score == pytest.approx(0.86) and len(got["a", "b"].factors) >= 3
    assert got["c", "d"].score < 0.55
    decided = spark.createDataFrame([("b", "a")], "a string, b string")
    assert [(p.a, p.b) for p in resolution.proposals(r, decided).collect()] == []
    ent = spark.createDataFrame([("a", "Rahul Sharma", ["Raju"], True), ("b", "R. Sharma", ["Rahul Sharma"], True)], "uid string, name string, aliases array<string>, active boolean")
    merged = {m.uid: m for m in resolution.merged(ent, spark.createDataFrame([("a", "b")], "a string, b string")).collect()}
    chain = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "y", 3)], "src string, dst string, n int").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    three = spark.createDataFrame([("a", "Jo", ["J"], True), ("b", "Joseph K", None, True), ("c", "Joe K", ["J", "K."], True), ("d", "Else", None, True)], "uid string, name string, aliases array<string>, active boolean")
    after = resolution.merged(three, chain)
    got = {r.uid: (r.active, r.alias_of, r.aliases) for r in after.collect()}
    assert got == {"a": (False, "b", ["J"]), "b": (True, None, ["J", "Jo", "Joe K", "K."]), "c": (False, "b", ["J", "K."]), "d": (True, None, [])}
    links = spark.createDataFrame([("a", "d", "MET", "OBSERVED"), ("c", "d", "MET", "OBSERVED"), ("a", "c", "MET", "OBSERVED")], "src string, dst string, type string, status string")
    assert {tuple(r) for r in resolution.rewritten(links, after).collect()} == {("b", "d", "MET", "OBSERVED"), ("b", "a", "alias_of", "VALIDATED"), ("b", "c", "alias_of", "VALIDATED")}
    assert merged["a"].aliases == ["R. Sharma", "Raju"] and not merged["b"].active and merged["b"].alias_of == "a"


NARRATIVE = "Mr Rahul Sharma called Anita Verma from 9876543210. On 10 January 2024 Mohan Lal transferred Rs 5,00,000 to Shivam Logistics Ltd near Lajpat Nagar."


def test_extraction(spark):
    docs = spark.createDataFrame([(1, NARRATIVE), (2, ""), (3, None)], "id int, text string")
    known = extraction.gazetteer(spark.createDataFrame([("p1", "person", "Rahul Sharma", ["Raju"]), ("p2", "person", "Vikas Sharma", []), ("l1", "location", "Lajpat Nagar", [])], "uid string, type string, name string, aliases array<string>"))
    parts = {(r.norm, r.uid) for r in known.where("part").collect()}
    assert ("rahul", "p1") in parts and not any(n == "sharma" for n, _ in parts)
    found = extraction.entities_in(docs, known)
    spans = {r.id: r.spans for r in found.collect()}
    assert spans[2] == spans[3] == []
    assert all(NARRATIVE[s.start : s.stop] == s.text for s in spans[1])
    assert {"person", "phone", "transaction", "organization", "location", "event"} <= {s.kind for s in spans[1]}
    assert next(s.uid for s in spans[1] if s.text == "Rahul Sharma") == "p1"
    relations = {(r.source, r.type, r.target) for r in extraction.relations_in(found).collect()}
    assert ("Rahul Sharma", "CALLED", "Anita Verma") in relations
    assert any(t == "TRANSFERRED_MONEY" and target.startswith("Shivam Logistics") for _, t, target in relations)
    facts = {r.id: r for r in extraction.summary(found, extraction.relations_in(found)).collect()}
    assert facts[2].confidence == 0 and facts[1].n_known == 2 and facts[1].confidence > 0.7


def test_encounters(spark):
    rows = [("a", 1, "2024-01-01"), ("b", 1, "2024-01-01"), ("a", 2, "2024-01-10"), ("b", 2, "2024-01-10"), ("a", 3, "2024-01-12"), ("b", 3, "2024-01-12"), ("c", 1, "2024-01-01")]
    events = spark.createDataFrame(rows, "uid string, location int, at string").selectExpr("uid", "location", "CAST(at AS TIMESTAMP_NTZ) AS seen_at")
    none = spark.createDataFrame([], "a string, b string")
    got = patterns.repeated_encounters(events, none).collect()
    assert [(r.a, r.b, r.slots, r.locations, r.days, r.escalating) for r in got] == [("a", "b", 3, 3, 3, True)]
    assert got[0].confidence == pytest.approx(0.90)
    assert patterns.repeated_encounters(events, spark.createDataFrame([("b", "a")], "a string, b string")).count() == 0


def test_writes(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (3, "z", None)], "id int, a string, b string")
    got = {r.id: (r.content_hash, r.is_duplicate) for r in writes.deduplicated(rows, ["a", "b"], "id").collect()}
    assert [got[i][1] for i in (1, 2, 3)] == [False, True, False]
    stored = spark.createDataFrame([(got[3][0],)], "content_hash string")
    assert {r.id: r.is_duplicate for r in writes.deduplicated(rows, ["a", "b"], "id", stored).collect()} == {1: False, 2: True, 3: True}
    sheet = spark.createDataFrame([("P", "Q", "9", None), ("P", "P", None, "L")], "person string, person_b string, phone string, location string")
    edges = writes.row_edges(sheet)
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {("P", "Q", "ASSOCIATED_WITH"), ("P", "9", "OWNED"), ("P", "L", "VISITED")}
    assert writes.inserted_edges(edges, edges).count() == edges.count()
    refs = writes.allocated(sheet, 41, ["person_b"]).select("ref").collect()
    assert sorted(r.ref for r in refs) == ["REL-000042", "REL-000043"]


def random_records(spark, n=150, seed=5):
    """Records of few names in large blocks, with aliases, shared identifiers, neighbours and cases."""
    rng = random.Random(seed)
    first, last = ("Asha", "Anil", "R.", "Ravi", "A.", "Meera K"), ("Sharma", "Verma", "S.", "V", "Sarma")
    rows = []
    for i in range(n):
        name = lambda: f"{rng.choice(first)} {rng.choice(last)}"
        ids = {k: str(rng.randrange(m)) for k, m in (("address", 12), ("dob", 12), ("phone", 60), ("vehicle", 60), ("id_proof", 90), ("email", 90)) if rng.random() < 0.4}
        near = sorted({f"n{rng.randrange(40)}" for _ in range(rng.randrange(5))})
        rows.append((f"u{i:03}", rng.choice(("person", "person", "organization")), name(), [name() for _ in range(rng.randrange(2))], ids, near, [rng.choice("xyz")] if rng.random() < 0.7 else []))
    rows += [("z1", "person", "", None, None, None, None), ("z2", "person", None, [], {}, [], [])]
    return spark.createDataFrame(rows, records(spark).schema)


def test_exact_pairs_lose_no_proposal(spark):
    r = random_records(spark).cache()
    keys = resolution.blocking_keys(r).groupBy("uid", "type").agg(F.collect_set("key").alias("keys"))
    a, b = (keys.select(F.col("uid").alias(x), "type", F.col("keys").alias(f"k{x}")) for x in "ab")
    every = a.join(b, "type").where("a < b").where(F.arrays_overlap("ka", "kb")).select("a", "b")
    scored = {(p.a, p.b): p.score for p in resolution.score_pairs(r, every).collect()}
    want = {p: s for p, s in scored.items() if s >= resolution.THRESHOLD}
    got = {(p.a, p.b): p.score for p in resolution.proposals(r, exact=True).collect()}
    capped = {(p.a, p.b) for p in resolution.candidate_pairs(r, largest=12).collect()}
    assert got == want and len(want) > 30
    assert not set(want) <= capped  # a cap of blocks hides some
    assert resolution.exact_pairs(r).count() < len(scored)
    with pytest.raises(ValueError):
        resolution.proposals(r, least=0.5, exact=True)


def test_pairs_without_evidence_stay_below_the_threshold():
    """The bounds behind exact_pairs: full values of all other factors, without what a key asks for."""
    w = resolution.WEIGHTS
    weak = max(s for s in resolution.IDENTIFIERS.values() if s < resolution.STRONG)
    assert [k for k, s in resolution.IDENTIFIERS.items() if s < resolution.STRONG] == ["address", "dob"]
    rest = w["name"] + w["phonetic"] + w["cases"]
    assert rest + max(w["abbreviation"], w["neighbours"]) < resolution.THRESHOLD
    assert rest + w["identifiers"] * weak < resolution.THRESHOLD


def test_person_records_take_the_first_phone_and_vehicle(spark):
    persons = spark.createDataFrame([("a", "A", [], {"phone": "own"}, ["x"]), ("b", "B", None, None, None), ("c", "C", [], {}, [])], "uid string, name string, aliases array<string>, attributes map<string,string>, cases array<string>")
    edges = spark.createDataFrame([("a", "f1", 1), ("a", "v1", 5), ("a", "v2", 2), ("b", "f2", 7), ("b", "f1", 7), ("b", "n", 0)], "uid string, neighbour string, at long")
    held = spark.createDataFrame([("f1", "phone", "91"), ("f2", "phone", "92"), ("v1", "vehicle", "DL 1-A"), ("v2", "vehicle", "DL 2-B")], "neighbour string, kind string, value string")
    got = {r.uid: r.attributes for r in resolution.person_records(persons, edges, held).collect()}
    assert got == {"a": {"phone": "own", "vehicle": "DL2B"}, "b": {"phone": "91"}, "c": {}}


def test_refreshed_queue(spark):
    kind = "a string, b string, status string, score double, factors array<string>"
    old = spark.createDataFrame([("a", "b", "PENDING", 0.5, ["old"]), ("a", "c", "REJECTED", 0.5, ["old"]), ("a", "d", "PENDING", 0.6, ["old"])], kind)
    found = spark.createDataFrame([("a", "b", "", 0.7, ["new"]), ("a", "c", "", 0.9, ["new"]), ("x", "y", "", 0.8, ["new"]), ("x", "z", "", 0.6, ["new"])], kind).drop("status")
    after = resolution.refreshed(old, found, limit=3)
    assert {tuple(r)[:4]: r.factors[0] for r in after.collect()} == {("a", "b", "PENDING", 0.7): "new", ("a", "c", "REJECTED", 0.5): "old", ("a", "d", "PENDING", 0.6): "old", ("x", "y", "PENDING", 0.8): "new"}
    ent = spark.createDataFrame([(u, u.upper(), []) for u in "abcdxy"], "uid string, name string, aliases array<string>")
    page = resolution.page(after, ent, "pending", limit=2).orderBy(F.desc("score")).collect()
    assert [(p.name_a, p.name_b, p.total, p.status_counts, p.review_required) for p in page] == [("X", "Y", 3, "PENDING:3,REJECTED:1", True), ("A", "B", 3, "PENDING:3,REJECTED:1", True)]
