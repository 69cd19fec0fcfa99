"""More registered queries: the composite read paths, and the single operators that they are built from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import text as X
from tessera.operators import extraction, graph, patterns, places, writes
from tessera.plans import model as M
from tessera.sources import cases
from tessera.storage import spread, stored
from tessera.plans.queries import ALL_LIVE, ALL_REL, ENT, INC, SRV, ZON, _adj, _all_adj, _all_hubs, _all_live, _all_nodes, _hubs, dist, machine_sql, paths_sql, query
from tessera.streaming import stateful


@query("A08_paragraphs", r"SELECT page_id, count(*) AS blocks FROM (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\n')) AS b FROM pages) WHERE trim(b) <> '' GROUP BY page_id")
def paragraphs(s, d):
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    return M.table(s, d, "pages").select("page_id", F.explode(F.split(plain, "\n")).alias("b")).where(F.trim("b") != "").groupBy("page_id").agg(F.count("*").alias("blocks"))


@query(
    "A23_case_report",
    """SELECT c_mktsegment AS case_id, count(*) AS n_entities, round(sum(c_acctbal), 2) AS balance, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal DESC, c_custkey) FILTER (WHERE place <= 5) AS leading
  FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) GROUP BY c_mktsegment""",
)
def case_report(s, d):
    c = M.table(s, d, "customer").withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")))
    lead = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "c_custkey")))), lambda r: r["c_custkey"].cast("string")), ",")
    return c.groupBy(F.col("c_mktsegment").alias("case_id")).agg(F.count("*").alias("n_entities"), F.round(F.sum("c_acctbal"), 2).alias("balance"), lead.alias("leading"))


@query("B14_audience", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT' OR (o_orderstatus IS NULL AND o_orderpriority IS NULL)")
def audience(s, d):
    return M.table(s, d, "orders").where((F.col("o_custkey") == 7) | (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderstatus").isNull() & F.col("o_orderpriority").isNull())).select("o_orderkey")


@query("B15_threshold", f"SELECT rid, confidence FROM {ALL_REL} WHERE confidence >= 0.8 AND status NOT IN ('REJECTED')")
def threshold(s, d):
    return M.all_relations(s, d).where((F.col("confidence") >= 0.8) & ~F.col("status").isin("REJECTED")).select("rid", "confidence")


@query("B22_role_visibility", f"WITH perm AS (SELECT * FROM (VALUES ('analyst', 'OBSERVED'), ('analyst', 'INFERRED'), ('viewer', 'OBSERVED')) t(role, status)) SELECT role, rid FROM {ALL_REL} JOIN perm USING (status)")
def role_visibility(s, d):
    allowed = s.createDataFrame([("analyst", "OBSERVED"), ("analyst", "INFERRED"), ("viewer", "OBSERVED")], "role string, status string")
    return M.all_relations(s, d).join(F.broadcast(allowed), "status").select("role", "rid")  # three rows; dealt by status, a task would get most relations


@query("C01_score_join", "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000")
def score_join(s, d):
    o = M.table(s, d, "orders").where("o_totalprice > 350000")
    return o.join(M.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("price"))


@query("C13_services_per_zone", f"SELECT zone_id, count(*) AS n FROM {SRV} JOIN {ZON} ON {dist('slat', 'slng', 'zlat', 'zlng')} <= radius GROUP BY zone_id")
def services_per_zone(s, d):
    centres = M.zones(s, d).select("zone_id", F.col("zlat").alias("clat"), F.col("zlng").alias("clng"), "radius")
    points = M.services(s, d).select("service_id", F.col("slat").alias("lat"), F.col("slng").alias("lng"))
    return places.within(points, centres, F.col("radius")).groupBy("zone_id").agg(F.count("*").alias("n"))


@query("C20_colocation", f"WITH e AS (SELECT DISTINCT subject, zone_id, CAST(seen_at AS DATE) AS day FROM {INC} WHERE priority = 'CRITICAL') SELECT a.subject AS a, b.subject AS b, count(*) AS n FROM e a JOIN e b ON a.zone_id = b.zone_id AND a.day = b.day AND a.subject < b.subject GROUP BY 1, 2")
def colocation(s, d):
    e = M.incidents(s, d).where("priority = 'CRITICAL'").select("subject", "zone_id", F.to_date("seen_at").alias("day")).distinct()
    met = patterns.encounters(e.select(F.col("subject").alias("uid"), F.col("zone_id").alias("location"), "day", F.lit(0).alias("time")))
    return met.groupBy("cell", "a", "b").agg(F.count("*").alias("n")).drop("cell")


@query("C22_supporting_records", f"SELECT a, b, string_agg(rid::VARCHAR, ',' ORDER BY rid) AS records FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, rid FROM {ALL_REL}) GROUP BY a, b")
def supporting_records(s, d):
    r = M.all_relations(s, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_list("rid")).alias("rids"))
    held = r.select("a", "b", F.posexplode("rids").alias("i", "rid")).join(M.all_relations(s, d).select("rid").distinct(), "rid")
    return held.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "rid"))), lambda x: x["rid"].cast("string")), ",").alias("records"))


@query("D02_page_total", f"SELECT count(*) AS total FROM {INC} WHERE priority = 'HIGH' AND type IN ('error', 'click')")
def page_total(s, d):
    return M.incidents(s, d).where("priority = 'HIGH' AND type IN ('error', 'click')").agg(F.count("*").alias("total"))


@query("D10_most_common", f"SELECT type, count(*) AS n FROM {ALL_REL} GROUP BY type ORDER BY n DESC, type LIMIT 12")
def most_common(s, d):
    return M.all_relations(s, d).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(12)


@query("D11_zone_types", f"SELECT zone_id, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type FROM (SELECT zone_id, type, count(*) AS n FROM {INC} GROUP BY ALL) GROUP BY zone_id")
def zone_types(s, d):
    t = M.incidents(s, d).groupBy("zone_id", "type").agg(F.count("*").alias("n"))
    return t.groupBy("zone_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), ",").alias("by_type"))


@query("D16_mean_confidence", f"SELECT round(coalesce(avg(c), 0), 6) AS confidence FROM (SELECT confidence AS c FROM {ALL_REL} UNION ALL SELECT 0.8::DOUBLE FROM {INC} WHERE priority = 'CRITICAL')")
def mean_confidence(s, d):
    c = M.all_relations(s, d).select("confidence").union(M.incidents(s, d).where("priority = 'CRITICAL'").select(F.lit(0.8)))
    return c.agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"))


@query("D23_corpus_summary", f"SELECT type, count(*) AS n, count(*) FILTER (WHERE active) AS active FROM {ENT} GROUP BY type")
def corpus_summary(s, d):
    return M.entities(s, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


@query("E05_keep_best", f"SELECT src, type, dst, rid FROM (SELECT *, row_number() OVER (PARTITION BY src, type, dst ORDER BY confidence DESC, rid) AS p FROM {ALL_REL}) WHERE p = 1")
def keep_best(s, d):
    return M.all_relations(s, d).groupBy("src", "type", "dst").agg(F.max_by("rid", F.struct("confidence", -F.col("rid"))).alias("rid"))


@query("E06_first_in_slot", f"SELECT zone_id, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS day, min(incident_id) AS incident_id FROM {INC} GROUP BY ALL")
def first_in_slot(s, d):
    return M.incidents(s, d).groupBy("zone_id", F.to_date("seen_at").cast("string").alias("day")).agg(F.min("incident_id").alias("incident_id"))


@query("E08_recent_share", f"SELECT subject, round(CASE WHEN count(*) >= 2 THEN count(*) FILTER (WHERE seen_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 10 DAY)::DOUBLE / count(*) WHEN count(*) = 1 THEN 0.2 ELSE 0 END, 6) AS share FROM {INC} GROUP BY subject")
def recent_share(s, d):
    n, late = F.count("*"), F.col("seen_at") >= F.lit(M.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(10))
    return M.incidents(s, d).groupBy("subject").agg(F.round(F.when(n >= 2, F.count_if(late) / n).when(n == 1, 0.2).otherwise(0.0), 6).alias("share"))


@query("F05_newest_ascending", f"SELECT incident_id, type FROM (SELECT * FROM {INC} ORDER BY seen_at DESC, incident_id DESC LIMIT 8) ORDER BY seen_at, incident_id")
def newest_ascending(s, d):
    return M.incidents(s, d).orderBy(F.desc("seen_at"), F.desc("incident_id")).limit(8).orderBy("seen_at", "incident_id").select("incident_id", "type")


@query("F09_slices", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:5], ',') AS first_five FROM orders GROUP BY o_custkey")
def slices(s, d):
    return M.table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5), lambda k: k.cast("string")), ",").alias("first_five"))


@query("F11_capped_subgraph", f"WITH {ALL_LIVE}, cap AS (SELECT uid FROM act WHERE starts_with(uid, 'c') OR starts_with(uid, 'o') ORDER BY uid LIMIT 1500) SELECT rid, src, dst FROM live WHERE src IN (SELECT uid FROM cap) AND dst IN (SELECT uid FROM cap)")
def capped_subgraph(s, d):
    cap = _all_nodes(s, d).where(F.col("uid").startswith("c") | F.col("uid").startswith("o")).orderBy("uid").limit(1500)
    return graph.induced(_all_live(s, d), cap).select("rid", "src", "dst")


@query("G04_concatenated", f"SELECT 'relation' AS kind, rid AS id FROM {ALL_REL} UNION ALL SELECT 'incident', incident_id FROM {INC}")
def concatenated(s, d):
    return M.all_relations(s, d).select(F.lit("relation").alias("kind"), F.col("rid").alias("id")).unionByName(M.incidents(s, d).select(F.lit("incident").alias("kind"), F.col("incident_id").alias("id")))


@query("G07_ordered_distinct", "SELECT l_orderkey, array_to_string(list_distinct_ordered, ',') AS modes FROM (SELECT l_orderkey, list(f ORDER BY first, f) AS list_distinct_ordered FROM (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey)")
def ordered_distinct(s, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return M.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["l_returnflag"])), ",").alias("modes"))


@query("G09_span_thinning")
def span_thinning(s, d):
    docs = M.table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return extraction.entities_in(docs).select("id", F.size("spans").cast("long").alias("n"), F.aggregate("spans", F.lit(0), lambda a, x: a + x["stop"] - x["start"]).cast("long").alias("covered"))


@query("H08_day_labels", "SELECT n_nationkey, strftime(DATE '2024-01-01' + (n_nationkey)::INTEGER, '%Y-%m-%d') AS day FROM nation")
def day_labels(s, d):
    text = F.concat(F.lit("Day "), (F.col("n_nationkey") + 1).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "-40").otherwise(""))
    return M.table(s, d, "nation").select("n_nationkey", F.date_format(X.day_label(text, F.lit("2024-01-01").cast("date")), "yyyy-MM-dd").alias("day"))


@query(
    "H13_sound",
    """WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(trim(p_name), '\\s+'), lambda x: x <> '')) AS word FROM part),
  l AS (SELECT word, upper(regexp_replace(word, '[^A-Za-z]', '', 'g')) AS letters FROM w),
  c AS (SELECT word, letters, translate(letters[1], 'HW', '77') || regexp_replace(letters[2:], '[HW]', '', 'g') AS code FROM l),
  d AS (SELECT word, letters, translate(code, 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556') AS code FROM c),
  r AS (SELECT word, letters, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS code FROM d)
  SELECT CASE WHEN letters = '' THEN '' ELSE letters[1] || left(replace(code[2:], '0', '') || '000', 3) END AS sound, count(*) AS words FROM r GROUP BY 1""",
)
def sounds(s, d):
    return M.table(s, d, "part").select(F.explode(X.words(F.col("p_name"))).alias("word")).groupBy(X.sound(F.col("word")).alias("sound")).agg(F.count_distinct("word").alias("words"))


@query(
    "H17_kernels",
    f"SELECT zone_id, round(pow(2.71828, -pow(1.5 / greatest(radius, 0.2), 2)), 6) AS kernel, round(greatest(0.35, 3.14159 * radius * radius), 6) AS area, round(1 - 0.3 / radius, 6) AS decay FROM {ZON}",
)
def kernels(s, d):
    r = F.col("radius")
    return M.zones(s, d).select("zone_id", F.round(geo.kernel(F.lit(1.5), r), 6).alias("kernel"), F.round(geo.zone_area(r), 6).alias("area"), F.round(1 - 0.3 / r, 6).alias("decay"))


@query("H24_night_factor", f"SELECT incident_id, CASE WHEN hour >= 20 OR hour <= 5 THEN 1.45::DOUBLE WHEN hour BETWEEN 17 AND 19 THEN 1.18 ELSE 1.0 END AS factor FROM {INC}")
def night_factors(s, d):
    return M.incidents(s, d).select("incident_id", geo.night_factor(F.col("hour")).alias("factor"))


@query("H27_labels", "SELECT DISTINCT event_type, upper(event_type[1:1]) || event_type[2:] AS label FROM events")
def labels(s, d):
    return M.table(s, d, "events").select("event_type", X.label(F.col("event_type")).alias("label")).distinct()


@query("H31_digests", "SELECT doc_id, sha256(text) AS digest, left(text, 160) AS head FROM documents")
def digests(s, d):
    return M.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring("text", 1, 160).alias("head"))


@query(
    "I03_shortest_paths",
    f"WITH RECURSIVE {paths_sql(10, 8)} SELECT src, dst, array_to_string(path, '>') AS path FROM path WHERE node = dst",
)
def shortest(s, d):
    h = _hubs(s, d, 10)
    pairs = h.select(F.col("uid").alias("src")).join(h.select(F.col("uid").alias("dst")), F.col("src") < F.col("dst"))
    return graph.shortest_paths(_adj(s, d), pairs, 8).select("src", "dst", F.array_join("path", ">").alias("path"))


@query("I20_edges_between", f"WITH {ALL_LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 3) SELECT DISTINCT rid, src, dst FROM live WHERE src IN (SELECT u FROM hub) OR dst IN (SELECT u FROM hub)")
def edges_for(s, d):
    hub, live = _all_hubs(s, d, 3), _all_live(s, d)
    a = live.join(hub.withColumnRenamed("uid", "src"), "src", "left_semi").select("rid", "src", "dst")
    return a.union(live.join(hub.withColumnRenamed("uid", "dst"), "dst", "left_semi").select("rid", "src", "dst")).distinct()


@query("I26_case_subgraph", f"WITH {ALL_LIVE} SELECT rid, src, dst FROM live WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def case_subgraph(s, d):
    case = M.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(M.uid("c", "c_custkey").alias("src"))
    return _all_live(s, d).join(case, "src", "left_semi").select("rid", "src", "dst")


@query("I28_common_connections", f"WITH {ALL_LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 40), s AS (SELECT x.u AS a, y.u AS b, x.v AS shared FROM adj x JOIN adj y ON x.v = y.v AND x.u < y.u WHERE x.u IN (SELECT u FROM hub) AND y.u IN (SELECT u FROM hub)), e AS (SELECT src AS x, dst AS y, rid FROM live UNION ALL SELECT dst, src, rid FROM live) SELECT a, b, shared, (SELECT string_agg(rid::VARCHAR, ',' ORDER BY rid) FROM e WHERE e.x = a AND e.y = shared) AS via_a, (SELECT string_agg(rid::VARCHAR, ',' ORDER BY rid) FROM e WHERE e.x = b AND e.y = shared) AS via_b FROM s")
def common_connections(s, d):
    live = _all_live(s, d)
    ends = live.select(F.col("src").alias("x"), F.col("dst").alias("shared"), "rid").union(live.select("dst", "src", "rid"))
    own = ends.groupBy("x", "shared").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rid")), lambda k: k.cast("string")), ",").alias("via"))
    own = own.join(_all_hubs(s, d, 40).withColumnRenamed("uid", "x"), "x", "left_semi")
    a, b = own.select(F.col("x").alias("a"), "shared", F.col("via").alias("via_a")), own.select(F.col("x").alias("b"), "shared", F.col("via").alias("via_b"))
    return a.join(b, "shared").where("a < b").select("a", "b", "shared", "via_a", "via_b")


@query("J05_gazetteer", f"SELECT lower(trim(name)) AS norm, min(uid) AS uid FROM {ENT} WHERE type = 'location' GROUP BY 1")
def gazetteer(s, d):
    e = M.entities(s, d).where("type = 'location'").withColumn("aliases", F.array().cast("array<string>"))
    return extraction.gazetteer(e).where("not part").select("norm", "uid")


def _order_files(s, d):
    """A case file rendered from each order: its customer and parts as entities, its lines (at most seven) as relationships."""
    line = M.table(s, d, "lineitem").join(M.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    customer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    relation = F.struct(
        F.col("l_linenumber").alias("n"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("id"), customer.alias("from"), part.alias("to"), F.lit("ORDERED").alias("relationship"),
        F.when(F.col("l_returnflag") == "R", "inferred").otherwise("observed").alias("evidence_type"), (1 - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("Day "), (F.col("l_linenumber") * 2).cast("string")).alias("time"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("FIR "), part)).alias("source"),
    )
    rows = line.groupBy("l_orderkey", customer.alias("customer")).agg(F.array_sort(F.collect_list(relation)).alias("relationships"), F.collect_set(part).alias("parts"))
    entity = lambda uid, kind, role: F.struct(uid.alias("id"), F.lit(kind).alias("type"), role.alias("role"))
    listed = F.concat(F.array(entity(F.col("customer"), "person", F.lit("witness"))), F.transform("parts", lambda p: entity(p, "case", F.lit(None).cast("string"))))
    text = F.to_json(F.struct(F.struct(F.col("customer").alias("title")).alias("metadata"), listed.alias("entities"), "relationships"))
    return rows.select(F.col("l_orderkey").alias("case_id"), text.alias("text"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-")).alias("prefix"), F.to_date(F.lit("2026-01-01")).alias("day_one"))


@query(
    "A10_case_relationships",
    """SELECT l_orderkey AS case_id, 'R' || l_linenumber AS rel_id, 'o' || l_orderkey || '-c' || o_custkey AS source, 'o' || l_orderkey || '-p' || l_partkey AS target, 'ORDERED' AS type,
  CASE WHEN l_returnflag = 'R' THEN 'INFERRED' ELSE 'OBSERVED' END AS status, 1 - l_discount AS confidence, (DATE '2026-01-01' + (2 * l_linenumber - 1)::INTEGER)::DATE AS day, 'Day ' || 2 * l_linenumber AS time_label,
  CASE WHEN l_linestatus = 'O' THEN 'FIR p' || l_partkey ELSE 'Case file' END AS source_ref, CASE WHEN l_linestatus = 'O' THEN 'FIR' ELSE 'Records' END AS source_type,
  'EV-' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey, l_returnflag <> 'R', 1 - l_discount, l_linestatus = 'O'))::VARCHAR, 4, '0') AS evidence_ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def case_relationships(s, d):
    parts = stored(cases.sections(_order_files(s, d)), "sections")
    return cases.relationships(parts, cases.entities(parts))


@query(
    "A10_case_entities",
    """SELECT DISTINCT l_orderkey AS case_id, 'o' || l_orderkey || '-p' || l_partkey AS uid, 'case_record' AS type, NULL AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT l_orderkey, 'o' || l_orderkey || '-c' || o_custkey, 'person', 'Witness' FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def case_entities(s, d):
    found = cases.entities(cases.sections(_order_files(s, d)))
    return found.select("case_id", "uid", "type", F.try_element_at("attributes", F.lit("role")).alias("role"))


@query(
    "J06_known_spans",
    f"""WITH row AS ({M.NARRATIVE_ROWS_SQL}), doc AS (SELECT id, string_split({M.NARRATIVE_TEXT_SQL}, ' ') AS w FROM row),
  ent AS (SELECT uid, 'person' AS kind, name FROM ({M.PERSONS_SQL}) UNION ALL SELECT DISTINCT 'f-' || firm, 'organization', firm FROM row),
  known AS (SELECT lower(name) AS norm, min(uid) AS uid, min(kind) AS kind FROM ent GROUP BY 1),
  gram AS (SELECT id, length(array_to_string(w[1:i], ' ')) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS start, trim(w[i + 1] || ' ' || w[i + 2], '.') AS text FROM doc, unnest(range(len(w) - 1)) AS u(i))
  SELECT id, text, kind, start::INTEGER AS start, (start + length(text))::INTEGER AS stop, 0.97::DOUBLE AS confidence, uid FROM gram JOIN known ON lower(text) = norm""",
)
def known_spans(s, d):
    docs = M.narratives(s, d)
    firms = docs.select(F.concat(F.lit("f-"), "firm").alias("uid"), F.lit("organization").alias("type"), F.col("firm").alias("name"), F.array().cast("array<string>").alias("aliases")).distinct()
    named = M.persons(s, d).select("uid", F.lit("person").alias("type"), "name", "aliases").unionByName(firms)
    found = extraction.gazetteer_spans(spread(docs.select("id", "text"), extraction.TASKS), extraction.gazetteer(named))
    return extraction.exploded(found, F.col("listed"), "s", "id").select("id", "s.text", "s.kind", "s.start", "s.stop", "s.confidence", "s.uid")


@query("J13_extraction_summary")
def extraction_summary(s, d):
    found = stored(extraction.entities_in(spread(M.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), extraction.TASKS)), "spans")
    return extraction.summary(found, extraction.relations_in(found)).withColumn("confidence", F.round("confidence", 4))


@query("L07_nearby_services", f"SELECT zone_id, service_id, round(k, 6) AS km FROM (SELECT zone_id, service_id, {dist('slat', 'slng', 'zlat', 'zlng')} AS k FROM {SRV} JOIN {ZON} ON TRUE) WHERE k <= 5")
def nearby_services(s, d):
    centres = M.zones(s, d).select("zone_id", F.col("zlat").alias("clat"), F.col("zlng").alias("clng"))
    points = M.services(s, d).select("service_id", F.col("slat").alias("lat"), F.col("slng").alias("lng"))
    return places.within(points, centres, F.lit(5.0)).select("zone_id", "service_id", F.round("distance", 6).alias("km"))


@query("M06_cooccurrence", f"SELECT 'incident' AS source, subject::VARCHAR AS uid, zone_id AS location, count(*) AS n FROM {INC} WHERE lat IS NOT NULL GROUP BY ALL UNION ALL SELECT 'residence', 'c' || c_custkey, c_nationkey, 1 FROM customer")
def cooccurrence(s, d):
    i = M.incidents(s, d).where("lat is not null").groupBy(F.col("subject").cast("string").alias("uid"), F.col("zone_id").alias("location")).agg(F.count("*").alias("n"))
    r = M.table(s, d, "customer").select(F.lit("residence").alias("source"), M.uid("c", "c_custkey").alias("uid"), F.col("c_nationkey").alias("location"), F.lit(1).cast("long").alias("n"))
    return i.select(F.lit("incident").alias("source"), "uid", "location", "n").union(r)


@query("M01_shared_vehicle", f"SELECT (subject % 97)::VARCHAR AS descriptor, count(*) AS n, round(least(0.88, 0.45 + 0.13 * count(*) + 0.05 * count(DISTINCT zone_id))::DOUBLE, 6) AS confidence FROM {INC} WHERE priority = 'CRITICAL' GROUP BY 1 HAVING count(*) >= 2")
def shared_vehicle(s, d):
    return patterns.shared_vehicle(M.incidents(s, d).where("priority = 'CRITICAL'"), F.col("subject") % 97).select("descriptor", "n", F.round("confidence", 6).alias("confidence"))


@query(
    "N07_entity_profile",
    f"WITH {ALL_LIVE} SELECT a.uid, coalesce(degree, 0)::BIGINT AS degree, (SELECT count(*) FROM live WHERE live.src = a.uid) AS outgoing, (SELECT count(*) FROM live WHERE live.dst = a.uid) AS incoming, (SELECT count(*) FROM orders WHERE 'c' || o_custkey = a.uid) AS orders FROM act a LEFT JOIN deg ON deg.u = a.uid WHERE starts_with(a.uid, 'c')",
)
def entity_profile(s, d):
    live = _all_live(s, d)
    deg = _all_adj(s, d).groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("degree"))
    out = live.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("outgoing"))
    back = live.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("incoming"))
    own = M.table(s, d, "orders").groupBy(M.uid("c", "o_custkey").alias("uid")).agg(F.count("*").alias("orders"))
    p = _all_nodes(s, d).where(F.col("uid").startswith("c"))
    for part in (deg, out, back, own):
        p = p.join(part, "uid", "left")
    return p.select("uid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "outgoing", "incoming", "orders")))


@query("N10_evidence_lineage", f"SELECT src, dst, count(*) AS edges, min(strftime(seen_at, '%Y-%m-%d')) AS first_seen, max(strftime(seen_at, '%Y-%m-%d')) AS last_seen, round(sum(amount), 2) AS amount FROM {ALL_REL} GROUP BY src, dst")
def evidence_lineage(s, d):
    day = F.date_format("seen_at", "yyyy-MM-dd")
    return M.all_relations(s, d).groupBy("src", "dst").agg(F.count("*").alias("edges"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.round(F.sum("amount"), 2).alias("amount"))


ALERT_EVENTS = {"view": "NEW", "click": "ACKNOWLEDGED", "signup": "ASSIGNED", "purchase": "RESPONDING", "error": "RESOLVED"}


@query(
    "O07_alert_machine",
    machine_sql(ALERT_EVENTS, stateful.ALERT_CHANGES, "NEW", "event_id, status, accepted"),
)
def alert_machine(s, d):
    names = F.create_map(*(F.lit(x) for pair in ALERT_EVENTS.items() for x in pair))
    e = M.table(s, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("seconds"), names[F.col("event_type")].alias("status"))
    return stateful.folded(e, "user_id", ["seconds", "event_id"], stateful.status_machine(stateful.ALERT_CHANGES, "NEW"), "boolean").select("event_id", "status", F.col("result").alias("accepted"))


@query("O09_linked_status", f"SELECT incident_id, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' WHEN o_orderstatus = 'P' THEN 'RESPONDING' ELSE 'NEW' END AS status FROM {INC} JOIN orders ON o_orderkey = incident_id")
def linked_status(s, d):
    o = M.table(s, d, "orders").select(F.col("o_orderkey").alias("incident_id"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "P", "RESPONDING").otherwise("NEW").alias("status"))
    return M.incidents(s, d).select("incident_id").join(o, "incident_id")


@query("P04_row_edges", "SELECT 'c' || o_custkey AS src, 'PRI' || o_orderpriority AS dst, 'ASSOCIATED_WITH' AS type, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'c' || o_custkey, o_orderstatus, 'VISITED', count(*) FROM orders GROUP BY ALL")
def row_edges(s, d):
    rows = M.table(s, d, "orders").select(M.uid("c", "o_custkey").alias("person"), F.concat(F.lit("PRI"), "o_orderpriority").alias("organization"), F.col("o_orderstatus").alias("location"))
    return writes.row_edges(rows).groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


@query("P07_delete", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def delete_rows(s, d):
    gone = M.table(s, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return writes.removed(M.table(s, d, "customer").select("c_custkey"), gone, ["c_custkey"])


@query("T01_case_list", "SELECT c_mktsegment AS case_id, count(*) AS entities, count(*) FILTER (WHERE c_acctbal < 0) AS flagged, max(c_custkey) AS last FROM customer GROUP BY 1 ORDER BY entities DESC, case_id")
def case_list(s, d):
    return M.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("case_id")).agg(F.count("*").alias("entities"), F.count_if(F.col("c_acctbal") < 0).alias("flagged"), F.max("c_custkey").alias("last")).orderBy(F.desc("entities"), "case_id")


@query("T16_incident_list", f"SELECT incident_id, type, priority FROM {INC} WHERE type = 'error' AND priority = 'MEDIUM' ORDER BY seen_at DESC NULLS LAST, incident_id LIMIT 25 OFFSET 25")
def incident_list(s, d):
    return M.incidents(s, d).where("type = 'error' AND priority = 'MEDIUM'").orderBy(F.desc_nulls_last("seen_at"), "incident_id").offset(25).limit(25).select("incident_id", "type", "priority")


@query("T18_alert_counts", f"SELECT priority, count(*) AS n, count(DISTINCT subject) AS subjects FROM {INC} WHERE seen_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 3 DAY GROUP BY priority")
def alert_counts(s, d):
    return M.incidents(s, d).where(F.col("seen_at") >= F.lit(M.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(3))).groupBy("priority").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))
