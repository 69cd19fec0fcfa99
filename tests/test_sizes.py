"""Steps that outgrew a size: the same results by plans that hold up."""

import datetime
import itertools
import json
import random

import duckdb
from pyspark.sql import functions as F

from tessera.plans import composites, workflows
from tessera.operators import alerts, extraction, graph, patterns, places, resolution, writes
from tessera.plans.queries import ORACLE_SQL, QUERIES
from tessera.sources import cases, ingestion


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_case_entities_are_not_broadcast(spark, tmp_path):
    text = json.dumps({"entities": [{"id": "V1", "type": "person"}, {"id": "V2", "type": "person"}], "relationships": [{"id": "R1", "from": "V1", "to": "V2"}], "note": "text", "none": None})
    path = str(tmp_path / "sections")
    cases.sections(spark.createDataFrame([("k", text, "", datetime.date(2026, 1, 1))], "case_id string, text string, prefix string, day_one date")).write.parquet(path)
    parts = spark.read.parquet(path)
    assert sorted((r.section, r.place) for r in parts.collect()) == [("entities", 0), ("entities", 1), ("relationships", 0)]
    found = cases.relationships(parts, cases.entities(parts))
    assert "BroadcastHashJoin" not in plan(found)  # estimates of what is read from a variant are far too small
    assert [(r.source, r.target) for r in found.collect()] == [("V1", "V2")]


def test_roster_leaves_out_the_rest_of_a_second(spark, tmp_path):
    now = datetime.datetime.fromisoformat(workflows.NOW)
    rows = [(1, now - datetime.timedelta(hours=1), 7, "purchase"), (2, now, 7, "error"), (3, now + datetime.timedelta(milliseconds=500), 7, "error"), (4, now + datetime.timedelta(milliseconds=1), 8, "signup")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        expected = con.execute(ORACLE_SQL["T04_roster"]).fetchall()
    got = [tuple(r) for r in workflows.roster(spark, str(tmp_path)).collect()]
    assert got == expected and [(r[0], r[4]) for r in got] == [(7, 1)]


def test_role_visibility_deals_no_relations_by_status(spark, small):
    assert "SortMergeJoin" not in plan(composites.role_visibility(spark, small))  # most relations have one status


def test_encounters_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    rows = sorted({(draw.randrange(40), draw.randrange(3), datetime.date(2024, 1, 1 + draw.randrange(3)), 0) for _ in range(300)} | {(u, 9, datetime.date(2024, 1, 9), 0) for u in range(100)})
    met = patterns.encounters(spark.createDataFrame(rows, "uid long, location int, day date, time int"), largest=200)
    got = sorted((r.a, r.b, r.location, r.day) for r in met.collect())
    assert got == sorted((x[0], y[0], x[1], x[2]) for x, y in itertools.product(rows, rows) if x[0] < y[0] and x[1:3] == y[1:3])
    sums = met.groupBy("cell", "a", "b").count()
    assert sums.groupBy("a", "b").count().where("count > 1").isEmpty()
    assert plan(sums).count("Exchange") == 1  # the slots; pairs aren't shuffled


def test_exact_pairs_meet_at_no_hub(spark):
    """Each record has one place that all share; two with an abbreviation share a second one, which is enough."""
    empty, none = [], {}
    rows = [(f"p{i:03}", "person", f"{chr(65 + i % 26)}{chr(97 + i % 25)}n Rao", empty, none, ["c"]) for i in range(300)] + [("q1", "person", "Asha Rao", empty, none, ["c"]), ("q2", "person", "A. Rao", empty, none, ["c"])]
    records = spark.createDataFrame(rows, "uid string, type string, name string, aliases array<string>, attributes map<string,string>, cases array<string>")
    edges = spark.createDataFrame([(r[0], "hub") for r in rows] + [("q1", "x"), ("q2", "x"), ("p000", "y")], "uid string, neighbour string")
    assert [(r.a, r.b) for r in resolution.exact_pairs(records, edges).collect()] == [("q1", "q2")]
    two = records.withColumn("cases", F.array(F.lit("c"), F.lit("d")))  # one common neighbour is enough with two cases
    got = {(r.a, r.b) for r in resolution.exact_pairs(two, edges).collect()}
    assert ("q1", "q2") in got and ("p000", "q2") in got
    assert got == {tuple(r) for r in resolution._abbreviated(two.select("uid", "name", "aliases", F.lit(1).alias("key"), F.lit(0).alias("role")), 1000).collect()}


def _plain_modularity(edges, label):
    total = {}
    for e in edges:
        for n in e:
            total[label[n]] = total.get(label[n], 0) + 1
    return sum(label[a] == label[b] for a, b in edges) / len(edges) - sum((t / (2 * len(edges))) ** 2 for t in total.values())


def test_small_components_take_no_rounds_of_moves(spark, small, monkeypatch):
    """Rings of twelve in threes, and a larger component: only its rows go by rounds, and all get communities."""
    rings = [(f"r{i}-{j}", f"r{i}-{(j + 1) % 12}") for i in range(8) for j in range(12)]
    draw = random.Random(4)
    large = sorted({(f"g{a}", f"g{b}") for a, b in (sorted(draw.sample(range(40), 2)) for _ in range(120))} | {("g0", f"g{i}") for i in range(1, 40)})
    adj = graph.adjacency(spark.createDataFrame(rings + large, "src string, dst string"))
    seen, inner = [], graph.moves
    monkeypatch.setattr(graph, "moves", lambda adj_, *rest: seen.append({r.u[0] for r in adj_.select("u").distinct().collect()}) or inner(adj_, *rest))
    found = {r.node: r.community for r in graph.modularity_communities(adj, whole=100).collect()}
    assert seen and set().union(*seen) == {"g"}
    assert found.keys() == {n for e in rings + large for n in e} and all(found[a].split("-")[0] == a.split("-")[0] or a[0] == found[a][0] == "g" for a in found)
    assert _plain_modularity(rings + large, found) >= _plain_modularity(rings + large, {a: a.split("-")[0] if a[0] == "r" else "g" for a in found}) - 1e-9
    seen.clear()
    assert QUERIES["I12_communities"](spark, small).count() == QUERIES["I10_components"](spark, small).count()
    assert not seen


def test_undecided_pairs_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Crowded names in blocks of 8, an id that comes twice, and null names: the rows of the SQL; exchanges hold parts only."""
    rows = [(i % 300, "x" if i % 3 else f"n{i % 7}", "b", 1, "t") for i in range(310)] + [(900, None, "b", 1, "t"), (901, None, "b", 1, "t")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        expected = sorted(con.execute(ORACLE_SQL["C10_undecided_pairs"]).fetchall())
    inner = workflows._pairs
    monkeypatch.setattr(workflows, "_pairs", lambda s, d: inner(s, d, 8))
    out = workflows.undecided(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == expected
    assert plan(out).split("SortMergeJoin")[0].count("Exchange") == 0


def test_contacts_meet_few_services_of_a_crowd(spark, monkeypatch):
    """Services crowded in one quarter, 100 of them at one place: the nearest three within reach, as from all pairs."""
    draw = random.Random(6)
    spots = [(28.5 + draw.random() * 0.04, 77.0 + draw.random() * 0.04) for _ in range(300)] + [(28.52, 77.02)] * 100 + [(28.7, 77.3), (28.7, 77.31)]
    services = [(i, *at) for i, at in enumerate(spots)]
    signals = [(i, None, None, 28.5 + draw.random() * 0.04, 77.0 + draw.random() * 0.04, None) for i in range(40)]
    signals += [(40, None, None, 28.7, 77.3, None), (41, None, None, 10.0, 10.0, None), (42, None, None, None, None, None), (43, None, None, 28.52, 77.02, None)]
    made, inner = [], places.within

    def watched(points, centres, *rest):
        out = inner(points, centres, *rest)
        if "service_id" in centres.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(places, "within", watched)
    s = spark.createDataFrame(signals, "sos_id long, subject_name string, note string, lat double, lng double, raised_at timestamp_ntz")
    v = spark.createDataFrame(services, "service_id long, clat double, clng double")
    z = spark.createDataFrame([(1, 28.5, 77.0)], "zone_id int, clat double, clng double")
    got = {r.sos_id: r.contacts for r in alerts.raised(s, z, v).sos.collect()}
    far = inner(s, v, F.lit(alerts.REACH_KM)).select("sos_id", "distance", "service_id").collect()
    want = {r[0]: [x[2] for x in sorted(r2 for r2 in map(tuple, far) if r2[0] == r[0])[:3]] for r in signals}
    assert got == want and want[43] == [300, 301, 302] and len(want[40]) == 2 and want[41] == []
    assert sum(made) < len(far) / 8


def test_levels_and_ids_are_not_broadcast(spark, monkeypatch):
    plans = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (plans.append((name, plan(df))), keep(df, name))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    adj = keep(graph.adjacency(edges), "adjacency")
    nodes = adj.select(F.col("u").alias("uid")).distinct()
    close = {r.uid: r.closeness for r in graph.closeness(nodes, adj, whole=0).collect()}
    between = {r.uid: r.betweenness for r in graph.betweenness(nodes, adj, whole=0).collect()}
    assert close == {"a": 0.5, "b": 0.75, "c": 0.75, "d": 0.5} and between["a"] == 0 and between["b"] > 0.6
    seen = [p for name, p in plans if name in ("steps", "level", "delta")]
    assert len(seen) > 8 and not any("BroadcastHashJoin" in p for p in seen)  # a level's file looks small, and rounds add up
    entities = keep(nodes.withColumn("active", F.lit(True)), "entities")
    relations = keep(edges.withColumn("status", F.lit("OBSERVED")), "relations")
    assert "BroadcastHashJoin" not in plan(graph.project(entities, relations))


def test_texts_are_dealt_over_more_tasks_than_cores(spark, small):
    cores = spark.sparkContext.defaultParallelism
    assert f"RoundRobinPartitioning({cores * extraction.TASKS})" in plan(QUERIES["J10_relations"](spark, small))  # a core's share was one task


def test_patterns_with_one_bound_match_the_same(spark):
    texts = ["He CALLED, recalled, uncalled and made a call to her; they made calls to x. met with, mets", "Works at A, worked for B; (employed by C) employee of", "a\nobserved the incident ₹5 Rs.7 fir 12/2024 IMEI 123456789012345 x@y.in @ab Day 3 3rd May 2024, 98xxxx12 A. Rao DL-1C AB 1234", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = [f"(?i){p}" for p in extraction.TRIGGERS.values()] + [p for _, p, _ in extraction.RECOGNISERS]
    new = [extraction.one_bound(p) for p in extraction.TRIGGERS.values()] + [extraction.begun(p, c) for (_, p, _), c in zip(extraction.RECOGNISERS, extraction.BEGINS, strict=True)]
    both = df.select(extraction.all_matches(F.col("text"), old).alias("a"), extraction.all_matches(F.col("text"), new).alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(map(len, both[0].a)) == 4


def test_live_relations_are_found_once(spark, small):
    semi = lambda name: plan(QUERIES[name](spark, small)).count("LeftSemi")
    assert semi("B17_typed_subgraph") == 8  # two for each of four kinds of relations; twice as many before
    assert semi("I29_overview") == 0 and semi("I18_neighbourhood") == 2  # of the stored live ones; before once more for each use


def test_new_edges_are_dealt_over_tasks_by_their_number(spark, small):
    rows = spark.createDataFrame([("a", "b", "new"), ("a", "b", "new"), ("c", "d", "new"), ("c", "d", "known"), (None, "e", "new"), (None, "e", "known"), ("f", "g", "known"), ("h", "i", "other"), ("j", "k", None)], "src string, dst string, status string")
    found = writes.unmatched(rows, F.col("status") == "new", F.col("status") == "known", ["src", "dst"], task_rows=1)
    assert found.rdd.getNumPartitions() == 9
    assert {tuple(r) for r in found.collect()} == {("a", "b"), (None, "e")} and found.count() == 2
    text = plan(QUERIES["C11_new_edges"](spark, small))
    assert "Join" not in text and "Sort" not in text and text.count("Exchange") == 1  # a join and a distinct held all rows of a shuffle's fixed partitions


def test_stated_facts_have_the_kind_of_the_first_span_without_a_join(spark):
    rows = [(1, "Asha met ORIENT. Orient rang.", [("Asha", "person", 0, 4, 0.9, None), ("ORIENT", "organization", 9, 15, 0.9, None), ("Orient", "person", 17, 23, 0.9, None)]), (2, "Asha rang.", [("Asha", "person", 0, 4, 0.9, None)]), (3, "", [])]
    facts = ingestion.stated(spark.createDataFrame(rows, f"id long, text string, spans array<{extraction.SPAN}>"), "f.txt")
    assert "Join" not in plan(facts)  # texts met their relations again for the kinds
    assert [(r.src_type, r.src, r.type, r.dst_type, r.dst) for r in facts.collect()] == [("person", "Asha", "MET", "organization", "ORIENT")]


def test_texts_without_digits_or_at_lose_no_span(spark):
    texts = ["Mr Rahul Sharma met Orient Traders.", "call 9812345678 or asha@mail.in, @asha_r, Rs 5,000", "DL 8C AA 1234 on 10 January 2024, FIR 12/2024, Day 3", "R. Verma, 2 lakh", "", "\u0665 lakh @\u0967"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    every = F.array(*(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))) for _, p, _ in extraction.RECOGNISERS))
    n = F.aggregate(every, F.lit(0), lambda a, x: a + x).alias("n")
    ruled = F.size(F.filter(extraction.rule_spans(F.col("text")), lambda s: ~s["confidence"].isin(0.68, 0.76, 0.94) | (s["kind"] == "transaction"))).alias("ruled")
    got = docs.select(n, ruled).collect()
    assert all(r.n == r.ruled for r in got) and sum(r.n for r in got) >= 9


def test_proposals_of_a_crowd_are_told_from_few_rows(spark, monkeypatch):
    """A crowd of one birthday whose names stand for each other, each with a case and a place of its own, and records of many cases and places; against all pairs."""
    draw = random.Random(4)
    rows = [(f"p{i:03}", "person", "A. Rao" if i % 2 else "Asha Rao", None, {"dob": "d"}, [f"c{i}"]) for i in range(120)]
    edges = [(r[0], r[0]) for r in rows]
    for i in range(40):
        name = f"{draw.choice(('Ravi', 'R.', 'Meera', 'M. K.', 'Anil K'))} {draw.choice(('Verma', 'V.', 'Nair'))}"
        ids = {k: draw.choice("xyz") for k in ("address", "dob") if draw.random() < 0.5}
        rows.append((f"q{i:03}", "person", name, [name.lower()] if i % 9 == 0 else [], ids, draw.sample("uvw", draw.randrange(4))))
        edges += [(f"q{i:03}", n) for n in {"hub", *draw.sample("abcdef", draw.randrange(4))} if n != "hub" or i % 7]
    records = spark.createDataFrame(rows, "uid string, type string, name string, aliases array<string>, attributes map<string,string>, cases array<string>").cache()
    near = spark.createDataFrame(edges, "uid string, neighbour string").cache()
    sizes, kept = [], resolution.stored
    monkeypatch.setattr(resolution, "stored", lambda df, name: sizes.append(kept(df, name)) or sizes[-1])
    got = {tuple(r) for r in resolution.proposals(records, edges=near, exact=True).select("a", "b", "score").collect()}
    assert max(t.count() for t in sizes) < 1000  # of 3,600 pairs of such names in the crowd
    key = resolution.blocking_keys(records)
    every = key.alias("x").join(key.alias("y"), "key").where("x.uid < y.uid").selectExpr("x.uid as a", "y.uid as b").distinct()
    want = {tuple(r) for r in resolution.score_pairs(records, every, near).where(F.col("score") >= resolution.THRESHOLD).select("a", "b", "score").collect()}
    assert got == want and len(want) > 5


def test_centralities_take_all_sources_of_graphs_of_any_size(spark, monkeypatch):
    """A tree of 729 with cross edges and a small graph: as by Brandes' sums in Python, in tasks by component, and the tree by levels in passes."""
    edges = [(f"r{i // 27:03}", f"r{i:03}") for i in range(1, 729)] + [(f"r{i:03}", f"r{i + 1:03}") for i in range(30, 60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")]
    adj = graph.adjacency(spark.createDataFrame(edges, "src string, dst string")).cache()
    nodes = adj.select(F.col("u").alias("uid")).distinct().cache()
    steps = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)
        steps.setdefault(b, set()).add(a)
    between, close = dict.fromkeys(steps, 0.0), {}
    for start in steps:
        order, distance, paths, depend = [start], {start: 0}, {start: 1}, dict.fromkeys(steps, 0.0)
        for u in order:
            for v in steps[u]:
                if v not in distance:
                    distance[v], paths[v] = distance[u] + 1, 0
                    order.append(v)
                if distance[v] == distance[u] + 1:
                    paths[v] += paths[u]
        for v in reversed(order[1:]):
            for u in steps[v]:
                if distance[u] == distance[v] - 1:
                    depend[u] += paths[u] / paths[v] * (1 + depend[v])
            between[v] += depend[v]
        far = sum(distance.values())
        close[start] = (len(order) - 1) / far * (len(order) - 1) / (len(steps) - 1)
    n = len(steps)
    assert n > 700
    between = {u: round(x / ((n - 1) * (n - 2)), 10) for u, x in between.items()}
    close = {u: round(x, 10) for u, x in close.items()}
    monkeypatch.setattr(graph, "LEVEL_ROWS", 250_000)  # three passes
    for whole in (graph.WHOLE_GRAPH, 100):
        assert {r.uid: round(r.betweenness, 10) for r in graph.betweenness(nodes, adj, whole=whole).collect()} == between
        assert {r.uid: round(r.closeness, 10) for r in graph.closeness(nodes, adj, whole=whole).collect()} == close


def test_no_switch_by_size_in_centralities(spark, small, monkeypatch):
    asked = []
    for name in ("betweenness", "closeness"):
        monkeypatch.setattr(graph, name, lambda nodes, adj, sources=None, **_: asked.append(sources) or nodes.selectExpr("uid", "0.0 as betweenness", "0.0 as closeness"))
    monkeypatch.setattr(graph, "EXACT_NODES", 1)
    QUERIES["I07_betweenness"](spark, small), QUERIES["I08_closeness"](spark, small)
    assert asked == [None, None] and not any("LIMIT" in ORACLE_SQL[q] for q in ("I07_betweenness", "I08_closeness"))


def test_ids_that_met_twice_are_found_without_all_that_met_once(spark, monkeypatch):
    """Crowds of many slots, each id in few: the same pairs as those of all encounters, with times, from far fewer rows."""
    draw = random.Random(6)
    rows = sorted({(u, f"l{draw.randrange(3)}", datetime.datetime(2024, 1, 1 + draw.randrange(5), draw.randrange(24))) for u in range(120) for _ in range(3)} | {(7, None, datetime.datetime(2024, 1, 1)), (9, "l1", None)}, key=str)
    events = spark.createDataFrame(rows, "uid long, location string, seen_at timestamp_ntz").cache()
    linked = F.col("a") % 10 == F.col("b") % 10
    order = lambda found: sorted(map(tuple, found.select("a", "b", "slots", "locations", "days", "escalating", F.round("confidence", 6)).collect()))
    asked = []
    monkeypatch.setattr(patterns, "encounters", lambda slots: asked.append(slots))
    got = order(patterns.repeated_encounters(events, linked, 0.0))
    few = order(patterns.repeated_encounters(events, linked))
    assert not asked and got
    monkeypatch.undo()
    monkeypatch.setattr(patterns, "_met_twice", lambda *args: None)
    assert order(patterns.repeated_encounters(events, linked, 0.0)) == got
    assert order(patterns.repeated_encounters(events, linked)) == few
