import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import alerts, graph
from tessera.operators.extraction import exploded
from tessera.operators.ranking import numbered
from tessera.plans import model as M
from tessera.sources import readers
from tessera.storage import spread
from tessera.streaming import feeds, projection
from tessera.streaming import stateful as S


def calls(spark, seconds):
    return spark.createDataFrame([("k", float(t), i) for i, t in enumerate(seconds)], "key string, seconds double, id int")


def test_rate_limit_ignores_rejected_calls(spark):
    got = S.folded(calls(spark, [0, 1, 2, 59, 60.5, 61.5, 62.5, 63]), "key", ["seconds"], S.rate_limit(3), "boolean")
    assert [r.result for r in got.orderBy("id").collect()] == [True, True, True, False, True, True, True, False]


def test_status_machine(spark):
    rows = [("a", s, float(i), i) for i, s in enumerate(["RECEIVED", "ASSIGNED", "RESPONDING", "RESOLVED", "RECEIVED"])] + [("b", s, float(i), 10 + i) for i, s in enumerate(["ASSIGNED", "RECEIVED", "RESOLVED", "ASSIGNED", "RECEIVED"])]
    table = spark.createDataFrame(rows, "key string, status string, seconds double, id int")
    done = S.folded(table, "key", ["seconds"], S.status_machine(S.SOS_CHANGES, "RECEIVED"), "boolean")
    assert [r.result for r in done.orderBy("id").collect()] == [True] * 4 + [False] + [False, True, False, True, True]
    kept = S.history(done.where("result"), "key", "seconds").where("key = 'a'").orderBy("seq").collect()
    assert [(r.seq, r.before) for r in kept] == [(1, None), (2, "RECEIVED"), (3, "ASSIGNED"), (4, "RESPONDING")]


def test_case_machine(spark):
    steps = ["OPEN", "UNDER_INVESTIGATION", "CLOSED", "RESOLVED", "CLOSED", "OPEN"]
    table = spark.createDataFrame([("c", s, float(i), i) for i, s in enumerate(steps)], "key string, status string, seconds double, id int")
    done = S.folded(table, "key", ["seconds"], S.status_machine(S.CASE_CHANGES, "OPEN"), "boolean")
    assert [r.result for r in done.orderBy("id").collect()] == [True, True, False, True, True, False]


def test_lock_out(spark):
    tries = [(t, ok) for t, ok in [(0, False), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True), (800, False), (906, True), (907, False)]]
    table = spark.createDataFrame([("k", float(t), ok, i) for i, (t, ok) in enumerate(tries)], "key string, seconds double, success boolean, id int")
    got = [r.result for r in S.folded(table, "key", ["seconds"], S.lock_out(), "string").orderBy("id").collect()]
    assert got == ["FAILED", "OK", "FAILED", "FAILED", "FAILED", "FAILED", "ACCOUNT_LOCKED", "REFUSED", "REFUSED", "OK", "FAILED"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = calls(spark, [0, 1, 2, 59, 60.5, 61.5, 62.5, 63])
    rows.where("id < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("id >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = S.folded_stream(stream, "key", ["seconds"], S.rate_limit(3), "boolean", "state string")
    query = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    try:
        query.processAllAvailable()
        got = {r.id: r.result for r in spark.table("limited").collect()}
    finally:
        query.stop()
    batch = {r.id: r.result for r in S.folded(rows, "key", ["seconds"], S.rate_limit(3), "boolean").collect()}
    assert got == batch


def test_numbers_and_replay(spark):
    rows = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"])
    assert sorted((r.k, r.seq) for r in rows.collect()) == [(i, i + 1) for i in range(1000)]
    assert S.ring(rows, 100).count() == 100 and S.replay(rows, 990).count() == 10


def test_delimited(spark, tmp_path):
    path = tmp_path / "calls.csv"
    path.write_text("﻿Person;Person B;Phone;Date\nRahul;=cmd;+91 98765;2024-01-05\n-;Anita;N/A;soon\n", encoding="utf-8")
    df = readers.read_delimited(spark, str(path))
    assert df.columns == ["person", "person_b", "phone", "date"]
    assert [tuple(r) for r in df.collect()] == [("Rahul", "'=cmd", "'+91 98765", "2024-01-05"), (None, "Anita", None, "soon")]
    tsv = tmp_path / "a.tsv"
    tsv.write_text("a\tb\n1\t2\n")
    assert readers.sniffed_separator(spark, str(tsv)) == "\t"


def test_json_sections_and_paragraphs(spark, tmp_path):
    path = tmp_path / "case.json"
    path.write_text(json.dumps({"case_id": "c", "entities": [{"id": "e1"}, {"id": "e2"}], "relationships": [{"from": "e1", "to": "e2"}]}))
    rows = readers.read_json(spark, str(path)).collect()
    assert sorted(r.section for r in rows) == ["entities", "entities", "relationships"]
    plain = tmp_path / "list.json"
    plain.write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r.a for r in readers.read_json(spark, str(plain)).collect()) == [1, 2]
    text = tmp_path / "note.txt"
    text.write_bytes("first caf\xe9\n\nsecond\n\n\n".encode("latin-1"))
    assert [r.text for r in readers.read_text(spark, str(text)).orderBy("block").collect()] == ["first café", "second"]


def test_uploads_and_exports(spark, tmp_path):
    for name, size in (("x.exe", 5), ("x.csv", 0), ("x.csv", 1 << 30)):
        with pytest.raises(ValueError):
            readers.check_upload(name, size)
    readers.check_upload("X.CSV", 5)
    df = spark.sql("SELECT 1 AS a, TIMESTAMP '2024-01-02 03:04:05' AS t, array(1) AS nested")
    readers.write_csv(readers.primitives_only(df), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().t == "2024-01-02T03:04:05"
    readers.write_json(df, f"{tmp_path}/json")
    readers.write_table(spark.range(10).toDF("k"), f"{tmp_path}/table", "k")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 10


def test_feeds(spark, tmp_path):
    rows = spark.createDataFrame([(i, 28.5 + i * 0.01, 77.0 if i != 3 else None) for i in range(6)], "incident_id int, lat double, lng double")
    for part in range(2):
        rows.where(F.col("incident_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    zones = spark.createDataFrame([("a", 28.5, 77.0), ("b", 28.55, 77.0)], "zone string, clat double, clng double")
    queries = [
        feeds.placed_incidents(stream, zones, f"{tmp_path}/placed", f"{tmp_path}/c1"),
        feeds.numbered_feed(stream, ["incident_id"], f"{tmp_path}/feed", f"{tmp_path}/c2"),
    ]
    for q in queries:
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    placed = {r.incident_id: r.zone for r in feeds.read_feed(spark, f"{tmp_path}/placed").collect()}
    assert placed == {0: "a", 1: "a", 2: "a", 3: None, 4: "b", 5: "b"}
    feed = feeds.read_feed(spark, f"{tmp_path}/feed")
    assert sorted(r.seq for r in feed.collect()) == [1, 2, 3, 4, 5, 6]
    assert S.replay(feed, 4).count() == 2


def test_feed_restarts_and_polls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "RING", 3)
    inbox, path, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "feed", "checkpoint"))

    def run(first, number):
        spark.range(first, first + number).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id bigint").parquet(inbox)
        q = feeds.numbered_feed(stream, ["id"], path, checkpoint)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(ValueError):
        feeds.poll(spark, path)
    for i in range(5):
        run(i * 10, 4)
    assert feeds.last_seq(spark, path) == 20 and sorted(feeds._entries(spark, path)) == [3, 4]
    assert feeds._entries(spark, path)[4] == [[2, 12], [3, 16], [4, 20]]
    rows = {r.id: r.seq for r in feeds.poll(spark, path).collect()}
    assert rows == {i * 10 + k: i * 4 + k + 1 for i in range(5) for k in range(4)}
    for since in range(21):
        assert sorted(r.seq for r in feeds.poll(spark, path, since).collect()) == list(range(since + 1, 21))
    assert {r.batch for r in feeds.poll(spark, path, 17).collect()} == {4}
    # a batch that failed after its rows were written and before they were published isn't seen, and gets the same numbers again
    for f in (tmp_path / "feed" / "_published").glob("*4*"):
        f.unlink()
    for name in ("4", ".4.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert feeds.last_seq(spark, path) == 16 and feeds.poll(spark, path).count() == 16
    run(50, 1)
    assert {r.id: r.seq for r in feeds.poll(spark, path).collect()} == rows | {50: 21}
    # the entry before is needed
    for f in (tmp_path / "feed" / "_published").glob("*"):
        f.unlink()
    with pytest.raises(Exception, match="has no entry"):
        run(60, 1)


@pytest.mark.parametrize("step, kind", [(S.rate_limit(3), "boolean"), (S.lock_out(3, 50.0), "string")])
def test_state_leaves_when_it_has_run_out(spark, tmp_path, step, kind):
    schema = "key string, at timestamp, seconds double, success boolean, id int"
    times = [[("a", 0), ("b", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5)], [("a", 30), ("a", 61), ("c", 62), ("e", 63), ("e", 64), ("e", 65)], [("d", 500)], [("d", 501)], [("a", 502), ("b", 503)]]
    batches, n = [], 0
    for part in times:
        batches.append([(k, 1000 + t, k == "d", n + i) for i, (k, t) in enumerate(part)])
        n += len(part)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got, sizes = {}, []
    make = lambda rows: spark.createDataFrame(rows, "key string, t int, success boolean, id int").select("key", F.timestamp_seconds("t").alias("at"), F.col("t").cast("double").alias("seconds"), "success", "id")
    try:
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        (tmp_path / "in").mkdir()
        out = S.timed_stream(stream, "key", "at", "0 seconds", ["seconds", "id"], step, kind)
        q = out.writeStream.foreachBatch(lambda b, _: got.update({r.id: r.result for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            for i, rows in enumerate(batches):
                make(rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
                q.processAllAvailable()
                sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    whole = S.folded(make([r for b in batches for r in b]), "key", ["seconds", "id"], step, kind)
    assert got == {r.id: r.result for r in whole.collect()}
    assert sizes[2] < sizes[1], sizes


def test_spread(spark):
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(9)
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(many).rdd.getNumPartitions() == 9
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))


def test_exploded(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "id int, v array<string>")
    assert [tuple(r) for r in exploded(rows, F.col("v"), "x", "id").collect()] == [(1, "a"), (1, "b")]


def test_projection_follows_changes(spark, small, tmp_path):
    """Inserts, rejections and a late change by stream give the degrees of a rebuild; a repeated batch and a read version recompute nothing."""
    rel = M.all_relations(spark, small).groupBy("rid").agg(F.min(F.struct("src", "dst", "status")).alias("e")).select("rid", "e.*")  # some lines share a number
    first = rel.where("rid % 3 <> 0").withColumn("change_no", F.lit(1).cast("long"))
    second = rel.where("rid % 3 = 0").withColumn("change_no", F.lit(2).cast("long"))
    third = rel.where("rid % 4 = 0").select("rid", "src", "dst", F.lit("REJECTED").alias("status"), F.lit(3).cast("long").alias("change_no"))
    late = rel.where("rid % 8 = 0").select("rid", "src", "dst", F.lit("OBSERVED").alias("status"), F.lit(2).cast("long").alias("change_no"))  # older than the rejection
    for i, part in enumerate((first, second, third, late)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        path = str(tmp_path / "graph")
        stream = spark.readStream.schema(projection.EDGES).parquet(f"{tmp_path}/in/*")
        q = projection.follow(stream, path, f"{tmp_path}/check")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert projection.version(spark, path) == 4
    final = rel.withColumn("status", F.when(F.col("rid") % 4 == 0, "REJECTED").otherwise(F.col("status")))
    adj = graph.adjacency(final.where("status <> 'REJECTED'"))
    assert sorted(map(tuple, projection.table(spark, path, "pairs").collect())) == sorted(map(tuple, adj.collect()))
    want = adj.groupBy("u").agg(F.count("*"), F.sum("n"))
    assert sorted(map(tuple, projection.table(spark, path, "degrees").collect())) == sorted(map(tuple, want.collect()))
    assert projection.apply(third, path, 3) == 4 and projection.version(spark, path) == 4
    calls = []

    def most(pairs, degrees):
        calls.append(1)
        return degrees.agg(F.max("degree").alias("most"))

    assert projection.cached(spark, path, "most", most).first() == projection.cached(spark, path, "most", most).first() and len(calls) == 1
    one = first.limit(1).withColumns({"status": F.lit("REJECTED"), "change_no": F.lit(9).cast("long")})
    before = projection._manifest(spark, path, 4)
    assert projection.apply(one, path, 5) == 5
    after = projection._manifest(spark, path, 5)
    assert 0 < sum(before.get(k) != v for k, v in after.items()) <= 5  # one bucket of edges, two at most of pairs and degrees
    projection.cached(spark, path, "most", most)
    assert len(calls) == 2
    old = projection.table(spark, path, "pairs", 4)
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, adj.collect()))  # readers of a version keep it


def test_raised_signals_have_a_linked_alert(spark):
    kind = "sos_id long, subject_name string, note string, lat double, lng double, raised_at string"
    signals = spark.createDataFrame([(1, "Asha", None, 28.5, 77.0, "t1"), (2, None, "help", None, None, "t2"), (3, "Ravi", "", 0.0, 0.0, "t3")], kind)
    zones = spark.createDataFrame([(7, 28.5, 77.01), (8, 28.5, 77.01), (9, 29.9, 77.0)], "zone_id int, clat double, clng double")
    services = spark.createDataFrame([(5, 28.5, 77.02), (4, 28.5, 77.02), (6, 28.5, 77.0), (2, 28.51, 77.05), (1, 30.0, 77.0)], "service_id long, clat double, clng double")
    out = alerts.raised(signals, zones, services)
    sos = {r.sos_id: r for r in out.sos.collect()}
    assert sos[1].zone_id == 7 and sos[1].contacts == [6, 4, 5] and sos[1].status == "RECEIVED"
    assert sos[2].zone_id is None and sos[2].contacts == [] and sos[3].contacts == []
    linked = {r.sos_id: (r.alert_ref, r.sos_ref, r.status, r.priority, r.message, r.detail) for r in out.alerts.collect()}
    assert linked[1] == ("A-SOS-0001", "SOS-0001", "NEW", "CRITICAL", "SOS raised by Asha", "One-tap SOS alert awaiting assignment.")
    assert linked[2][4:] == ("SOS raised by an unnamed person", "help") and len(linked) == 3
    assert {tuple(r) for r in out.history.select("sos_id", "from_status", "to_status").collect()} == {(k, None, "RECEIVED") for k in (1, 2, 3)}
    assert out.alerts.where("false").count() == alerts.raised(signals.where("false"), zones, services).alerts.count() == 0


def test_accounts_lock_after_five_failures(spark):
    tries = [("a", i, 100 + i, False) for i in range(5)] + [("a", 9, 120, True), ("b", 1, 50, False), ("b", 2, 60, True), ("b", 3, 70, False), ("b", 4, 70, False), ("c", 1, 10, False)]
    rows = spark.createDataFrame(tries, "user_id string, event_id long, seconds long, success boolean")
    done = S.folded(rows, "user_id", ["seconds", "event_id"], S.lock_out(), "string")
    got = {r.user_id: tuple(r)[1:] for r in S.accounts(done, F.lit(1003), session=950).collect()}
    assert got == {"a": (None, 1004, True, 0, 0), "b": (60, None, False, 2, 1), "c": (None, None, False, 1, 0)}
    assert not any(r.locked for r in S.accounts(done, F.lit(1004)).collect())
