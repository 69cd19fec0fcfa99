"""Known surfaces in texts against a search of all runs of words, and places of matches against plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction

MARKS = ".,;:!?()[]\"'"
ENTITY = "uid string, type string, name string, aliases array<string>"
TEXT = "id int, text string"


def plain_spans(text, whole, parts, most):
    """All runs of words of each length, longest first."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    free, out = set(range(len(words))), []
    for size in range(most, 0, -1):
        for i in range(len(words) - size + 1):
            clean = text[words[i][0] : words[i + size - 1][1]].strip(MARKS)
            uid = whole.get(" ".join(clean.split()).lower().rstrip("."))
            if uid and len(clean) >= 2 and free.issuperset(range(i, i + size)):
                free -= set(range(i, i + size))
                out.append((text.index(clean, words[i][0]), clean, uid))
    for i in sorted(free):
        clean = text[slice(*words[i])].strip(MARKS)
        if len(clean) >= 3 and clean[0].isupper() and clean.lower() in parts:
            out.append((text.index(clean, words[i][0]), clean, parts[clean.lower()]))
    return sorted(out)


@pytest.fixture(scope="module")
def known(spark):
    rows = [
        ("p1", "person", "Rahul Sharma", ["Raju"]),
        ("p2", "person", "Vikas Sharma", ["V. Sharma"]),
        ("p3", "person", "Sharma Rahul Dev Anand Prasad", []),
        ("l1", "location", "Lajpat Nagar", ["New Delhi"]),
        ("l2", "location", "Nagar", []),
        ("l3", "location", "a b c d e f g", []),
        ("o1", "organization", "Orient Co.", ["New  New Co"]),
        ("o2", "organization", "Été Straße", []),
        ("t1", "phone", "+91 98765 43210", []),
        ("v1", "vehicle", "DL 8C AA 1234", []),
        ("x1", "location", "...", None),
    ]
    return extraction.gazetteer(spark.createDataFrame(rows, ENTITY))


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_spans_equal_a_search_of_all_runs(spark, known, threshold):
    pick = random.Random(5)
    vocabulary = ["Rahul", "Sharma", "Vikas", "vikas", "V.", "Raju,", "Lajpat", "Nagar.", "nagar", "(", "...", "New", "new", "Delhi!", "Co", "Co.", "Orient", "(Dev", "Dev", "Anand", "Prasad", "\"Été", "STRASSE", "Straße'", "x", "a", "b", "c", "d", "e", "f", "g"]
    texts = ["".join(pick.choice(vocabulary) + pick.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(pick.randrange(1, 30))) for _ in range(400)]
    texts += ["Sharma Rahul Dev Anand Prasad", "( Raju )", "Raju , . ! ?", "Raju , . ! ? ;", "Raju , . ! ? ; :", "", " ", "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXT)
    own = {r.norm: r for r in known.where("not part").collect()}
    parts = {r.norm: r.uid for r in known.where("part").collect()}
    assert parts == {"vikas": "p2", "dev": "p3", "anand": "p3", "prasad": "p3"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.id: sorted((s.start, s.text, s.uid) for s in r.listed) for r in extraction.gazetteer_spans(docs, known).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = {norm: r.uid for norm, r in own.items() if len(norm.split(" ")) <= 6}
    assert got == {i: plain_spans(t, whole, parts, 6) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 800


def test_nulls_and_repeated_rows(spark, known):
    docs = spark.createDataFrame([(1, "Raju"), (1, "Vikas"), (1, "Raju"), (None, "met Raju"), (None, None), (2, None)], TEXT)
    got = sorted((r.id or 0, r.text or "", [s.uid for s in r.listed]) for r in extraction.gazetteer_spans(docs, known).collect())
    assert got == [(0, "", []), (0, "met Raju", ["p1"]), (1, "Raju", ["p1"]), (1, "Raju", ["p1"]), (1, "Vikas", ["p2"]), (2, "", [])]
    nothing = spark.createDataFrame([], ENTITY)
    assert all(r.listed == [] for r in extraction.gazetteer_spans(docs, extraction.gazetteer(nothing)).collect())
    assert extraction.gazetteer_spans(docs.limit(0), known).count() == 0


def test_rule_spans_get_the_known_entity(spark, known):
    docs = spark.createDataFrame([(1, "He called 098765-43210 from DL-8C-AA-1234."), (2, "He called 9876543210."), (3, "He called 9876543211.")], TEXT)
    got = {r.id: {(s.kind, s.uid) for s in r.spans} for r in extraction.entities_in(docs, known).collect()}
    assert ("vehicle", "v1") in got[1] and ("phone", "t1") in got[2] and ("phone", None) in got[3]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 1000])
def test_places_of_matches(spark, n):
    text = " é, ".join("w" * (i % 5 + 1) for i in range(n))
    got = spark.createDataFrame([(text,)], "text string").select(extraction.matches(F.col("text"), r"w+").alias("m")).first().m
    assert [(m.text, m.start, m.stop) for m in got] == [(m.group(), *m.span()) for m in re.finditer("w+", text)]


def test_an_index_row_for_each_surface(spark, known):
    rows = extraction.surface_index(known).collect()
    assert len({(r.norm, r.part) for r in rows}) == len(rows) and {r.most for r in rows} == {6}
    assert next(r.core for r in rows if r.norm == "rahul sharma") == "rahul"
