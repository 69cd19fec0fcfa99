"""The registered queries over the case graph, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import text as X
from tessera.operators import extraction, graph, patterns, places, ranking, resolution, scoring, writes
from tessera.operators.components import components
from tessera.plans import model as M
from tessera.storage import spread, stored
from tessera.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIST = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def dist(a: str, c: str, b: str, d: str) -> str:
    """SQL of the distance between (a, c) and (b, d): latitudes a and b, longitudes c and d."""
    return DIST.format(a=a, b=b, c=c, d=d)


ENT, REL, INC, ZON, SRV, ALL_ENT, ALL_REL = (f"({x})" for x in (M.ENTITIES_SQL, M.RELATIONS_SQL, M.INCIDENTS_SQL, M.ZONES_SQL, M.SERVICES_SQL, M.ALL_ENTITIES_SQL, M.ALL_RELATIONS_SQL))
#: Common table expressions: live edges, both directions, degrees; of the sparse graph and of the whole one.
GRAPH = """ent AS {ent}, rel AS {rel},
  act AS (SELECT uid FROM ent WHERE active),
  live AS (SELECT * FROM rel WHERE status <> 'REJECTED' AND src IN (SELECT uid FROM act) AND dst IN (SELECT uid FROM act)),
  adj AS (SELECT u, v, count(*) AS n FROM (SELECT src AS u, dst AS v FROM live UNION ALL SELECT dst, src FROM live) GROUP BY u, v),
  deg AS (SELECT u, count(*) AS degree, sum(n)::BIGINT AS weighted FROM adj GROUP BY u)"""
LIVE, ALL_LIVE = GRAPH.format(ent=ENT, rel=REL), GRAPH.format(ent=ALL_ENT, rel=ALL_REL)

#: Searches from all nodes of the sparse graph: found has distances and counts of shortest paths.
SEARCH = f"""{LIVE}, size AS (SELECT count(*) AS n FROM deg),
  found(source, node, hop, paths) USING KEY (source, node) AS (SELECT u, u, 0, 1.0::DOUBLE FROM deg
    UNION SELECT f.source, adj.v, f.hop + 1, sum(f.paths) FROM found f JOIN adj ON adj.u = f.node
      WHERE NOT EXISTS (SELECT 1 FROM recurring.found r WHERE r.source = f.source AND r.node = adj.v) GROUP BY f.source, adj.v, f.hop)"""


def paths_sql(hubs: int, longest: int) -> str:
    """SQL of path, which holds the first shortest path of each pair of hubs once it ends in dst.

    At each node it goes on to the smallest neighbour that lies nearer to the end.
    """
    return f"""{LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT {hubs}), pair AS (SELECT a.u AS src, b.u AS dst FROM hub a JOIN hub b ON a.u < b.u),
  walk AS (SELECT u AS dst, u AS node, 0 AS hop FROM hub UNION SELECT dst, adj.v, hop + 1 FROM walk JOIN adj ON adj.u = node WHERE hop < {longest}),
  near AS (SELECT dst, node, min(hop) AS hop FROM walk GROUP BY ALL),
  onward AS (SELECT x.dst, x.node, min(y.node) AS next FROM near x JOIN adj ON adj.u = x.node JOIN near y ON y.dst = x.dst AND y.node = adj.v AND y.hop = x.hop - 1 GROUP BY ALL),
  path AS (SELECT src, dst, src AS node, [src] AS path FROM pair SEMI JOIN near ON near.dst = pair.dst AND near.node = pair.src
    UNION ALL SELECT p.src, p.dst, next, list_append(p.path, next) FROM path p JOIN onward o ON o.dst = p.dst AND o.node = p.node WHERE p.node <> p.dst)"""


def turns_sql(what: str, where: str = "TRUE") -> str:
    """SQL of turn: each user's events in order, numbered by i from 1."""
    order = "epoch_us(ts) // 1000000, event_id"
    return f"turn AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS seconds, {what}, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM events WHERE user_id IS NOT NULL AND {where})"


def machine_sql(names: dict[str, str], changes: dict[str, tuple[str, ...]], first: str, columns: str, where: str = "TRUE") -> str:
    """SQL of a status machine over each user's events, one event after the other; names: an event type's status."""
    status = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    allowed = ", ".join(f"'{a}>{b}'" for a, bs in changes.items() for b in bs)
    return f"""WITH RECURSIVE {turns_sql(f"{status} AS status", where)},
  step AS (SELECT user_id, event_id, i, status, CASE WHEN status = '{first}' THEN status END AS present, coalesce(status = '{first}', FALSE) AS accepted FROM turn WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, status, CASE WHEN good THEN status ELSE present END, good
      FROM (SELECT t.*, present, coalesce(CASE WHEN present IS NULL THEN t.status = '{first}' ELSE present || '>' || t.status IN ({allowed}) END, FALSE) AS good FROM step s JOIN turn t ON t.user_id = s.user_id AND t.i = s.i + 1))
  SELECT {columns} FROM step"""


def _live(s: SparkSession, d: str) -> DataFrame:
    return graph.project(M.entities(s, d), M.relations(s, d))


def _adj(s: SparkSession, d: str) -> DataFrame:
    """Stored once: searches by rounds read it again and again."""
    return stored(graph.adjacency(_live(s, d)), "adjacency")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return M.entities(s, d).where("active").select("uid")


def _hubs(s: SparkSession, d: str, k: int) -> DataFrame:
    """The k entities of the highest degree (ties by id): a fixed set of starting points."""
    return _top(_adj(s, d), k)


def _top(adj: DataFrame, k: int) -> DataFrame:
    return adj.groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "uid").limit(k).select("uid")


def _hub_pairs(adj: DataFrame, k: int) -> DataFrame:
    """(src, dst) of the k entities of the highest degree, each pair once."""
    h = stored(_top(adj, k), "hubs")
    return h.select(F.col("uid").alias("src")).join(h.select(F.col("uid").alias("dst")), F.col("src") < F.col("dst"))


def _all_live(s: SparkSession, d: str) -> DataFrame:
    return graph.project(M.all_entities(s, d), M.all_relations(s, d))


def _all_adj(s: SparkSession, d: str) -> DataFrame:
    return stored(graph.adjacency(_all_live(s, d)), "all_adjacency")


def _all_nodes(s: SparkSession, d: str) -> DataFrame:
    return M.all_entities(s, d).where("active").select("uid")


def _all_hubs(s: SparkSession, d: str, k: int) -> DataFrame:
    return _top(_all_adj(s, d), k)


# ---- flagship: projection, degree, percentile rank, band


@query(
    "I24_projection_rank",
    f"""WITH {ALL_LIVE},
  base AS (SELECT a.uid, coalesce(degree, 0)::BIGINT AS degree, coalesce(weighted, 0)::BIGINT AS weighted FROM act a LEFT JOIN deg ON a.uid = deg.u),
  ranked AS (SELECT *, (rank() OVER (ORDER BY weighted) - 1)::DOUBLE / count(*) OVER () AS r FROM base)
  SELECT uid, degree, weighted, round(r, 6) AS weighted_rank,
    CASE WHEN r * 100 >= 75 THEN 'CRITICAL' WHEN r * 100 >= 55 THEN 'HIGH' WHEN r * 100 >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM ranked""",
)
def projection_rank(s: SparkSession, d: str) -> DataFrame:
    degree = graph.degrees(_all_nodes(s, d), _all_adj(s, d))
    out = ranking.percentile_rank(degree, "weighted", "r")
    return out.select("uid", "degree", "weighted", F.round("r", 6).alias("weighted_rank"), geo.band(F.col("r") * 100, geo.SCORE_BANDS, "LOW").alias("band"))


# ---- filters and projections


@query("A02_point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_lookup(s, d):
    return M.table(s, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_nationkey")


@query(
    "A25_source_catalogue",
    "WITH c AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'export']) AS source_type) SELECT source_type, count(event_id) AS records FROM c LEFT JOIN events ON event_type = source_type GROUP BY source_type",
)
def source_catalogue(s, d):
    kinds = s.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view", "export")], "source_type string")
    n = M.table(s, d, "events").groupBy(F.col("event_type").alias("source_type")).agg(F.count("*").alias("n"))
    return kinds.join(n, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("records"))


@query("B02_optional_filters", f"SELECT incident_id, type, priority FROM {INC} WHERE type = 'error' AND priority IN ('HIGH', 'CRITICAL') AND device IS NOT NULL")
def optional_filters(s, d):
    chosen = {"type": "error", "subject": None}
    equal = [F.col(k) == v if v is not None else None for k, v in chosen.items()]
    return M.incidents(s, d).where(writes.conjunction([*equal, F.col("priority").isin("HIGH", "CRITICAL"), F.col("device").isNotNull()])).select("incident_id", "type", "priority")


@query("B03_inequality", f"SELECT rid, src, dst, status FROM {ALL_REL} WHERE status <> 'REJECTED'")
def inequality(s, d):
    return M.all_relations(s, d).where("status <> 'REJECTED'").select("rid", "src", "dst", "status")


@query("B05_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(s, d):
    big = M.table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return M.table(s, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("B09_substring", f"SELECT uid, type, name FROM {ENT} WHERE contains(lower(name), 'ar') OR contains(uid, '77')")
def substring(s, d):
    return M.entities(s, d).where(F.lower("name").contains("ar") | F.col("uid").contains("77")).select("uid", "type", "name")


@query("B11_recent", f"SELECT incident_id, type FROM {INC} WHERE seen_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 7 DAY")
def recent(s, d):
    return M.incidents(s, d).where(F.col("seen_at") >= F.lit(M.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))).select("incident_id", "type")


@query("B12_date_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def date_range(s, d):
    bounds = {"from": "1996-01-01", "to": "1996-06-30", "other": "no date"}
    as_time = lambda k: F.try_to_timestamp(F.lit(bounds[k]), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return M.table(s, d, "orders").where(F.coalesce(at >= as_time("from"), F.lit(True)) & F.coalesce(at <= as_time("to"), F.lit(True)) & F.coalesce(at >= as_time("other"), F.lit(True))).select("o_orderkey", "o_totalprice")


@query("B13_hour_window", f"SELECT incident_id, hour FROM {INC} WHERE hour >= 21 OR hour <= 4")
def hour_window(s, d):
    first, last = 21, 4
    h = F.col("hour")
    return M.incidents(s, d).where(h.between(first, last) if first <= last else (h >= first) | (h <= last)).select("incident_id", "hour")


@query("B17_typed_subgraph", f"WITH {ALL_LIVE} SELECT rid, src, dst FROM live WHERE src IN (SELECT uid FROM ent WHERE type IN ('person', 'transaction')) AND dst IN (SELECT uid FROM ent WHERE type IN ('person', 'transaction'))")
def typed_subgraph(s, d):
    kinds = F.bool_or(F.col("type").isin("person", "transaction"))
    own = M.all_entities(s, d).groupBy("uid").agg(F.bool_or("active").alias("active"), kinds.alias("wanted")).where("active and wanted")
    return graph.induced(M.all_relations(s, d).where("status <> 'REJECTED'"), own).select("rid", "src", "dst")  # live ones: both ends are active


@query(
    "B18_event_types",
    f"SELECT rid, CASE type WHEN 'TRANSFERRED_MONEY' THEN 'FINANCIAL' WHEN 'OWNED' THEN 'OWNERSHIP' ELSE 'OTHER' END AS event_type, status IN ('OBSERVED', 'VALIDATED') AS is_observed FROM {ALL_REL}",
)
def event_types(s, d):
    kinds = F.create_map(*(F.lit(x) for x in ("TRANSFERRED_MONEY", "FINANCIAL", "OWNED", "OWNERSHIP", "VISITED", "MOVEMENT")))
    return M.all_relations(s, d).select("rid", F.coalesce(kinds[F.col("type")], F.lit("OTHER")).alias("event_type"), F.col("status").isin("OBSERVED", "VALIDATED").alias("is_observed"))


@query(
    "B20_directions",
    f"SELECT uid, direction, count(*) AS n, count(DISTINCT other) AS others FROM (SELECT src AS uid, 'outgoing' AS direction, dst AS other FROM {ALL_REL} UNION ALL SELECT dst, 'incoming', src FROM {ALL_REL}) GROUP BY ALL",
)
def directions(s, d):
    ends = F.array(F.struct(F.col("src").alias("uid"), F.lit("outgoing").alias("direction"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("uid"), F.lit("incoming").alias("direction"), F.col("src").alias("other")))
    return M.all_relations(s, d).select(F.explode(ends).alias("e")).select("e.*").groupBy("uid", "direction").agg(F.count("*").alias("n"), F.count_distinct("other").alias("others"))


# ---- joins


@query(
    "C04_endpoint_names",
    f"WITH e AS {ALL_ENT} SELECT rid, a.name AS src_name, b.name AS dst_name FROM {ALL_REL} r LEFT JOIN e a ON r.src = a.uid LEFT JOIN e b ON r.dst = b.uid",
)
def endpoint_names(s, d):
    e = M.all_entities(s, d)
    a, b = e.select(F.col("uid").alias("src"), F.col("name").alias("src_name")), e.select(F.col("uid").alias("dst"), F.col("name").alias("dst_name"))
    return M.all_relations(s, d).join(a, "src", "left").join(b, "dst", "left").select("rid", "src_name", "dst_name")


@query(
    "C05_child_lists",
    "SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def child_lists(s, d):
    own = M.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("orders"))
    return M.table(s, d, "customer").select("c_custkey").join(own, "c_custkey", "left")


@query("C07_left_default", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def left_default(s, d):
    n = M.table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return M.table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("C11_new_edges", f"SELECT DISTINCT src, dst, type FROM {ALL_REL} r WHERE status = 'OBSERVED' AND NOT EXISTS (SELECT 1 FROM {ALL_REL} o WHERE o.src = r.src AND o.dst = r.dst AND o.type = r.type AND o.status = 'INFERRED')")
def new_edges(s, d):
    return writes.unmatched(M.all_relations(s, d), F.col("status") == "OBSERVED", F.col("status") == "INFERRED", ["src", "dst", "type"])


@query(
    "C12_zone_incidents",
    f"SELECT zone_id, count(*) AS n, round(min(k), 6) AS nearest FROM (SELECT z.zone_id, radius, {dist('lat', 'lng', 'zlat', 'zlng')} AS k FROM {INC} i JOIN {ZON} z ON lat IS NOT NULL) WHERE k <= radius * 1.5 GROUP BY zone_id",
)
def zone_incidents(s, d):
    centres = M.zones(s, d).select(F.col("zone_id").alias("zone"), F.col("zlat").alias("clat"), F.col("zlng").alias("clng"), "radius")
    near = places.within(M.incidents(s, d), centres, F.col("radius") * 1.5)
    return near.groupBy(F.col("zone").alias("zone_id")).agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


@query(
    "C15_nearest_zone",
    f"SELECT incident_id, arg_min(z.zone_id, (round({dist('lat', 'lng', 'zlat', 'zlng')}, 9), z.zone_id)) AS zone FROM {INC} i JOIN {ZON} z ON lat IS NOT NULL GROUP BY incident_id",
)
def nearest_zone(s, d):
    centres = M.zones(s, d).select(F.col("zone_id").alias("zone"), F.col("zlat").alias("clat"), F.col("zlng").alias("clng"))
    return places.nearest(M.incidents(s, d).select("incident_id", "lat", "lng"), centres, "incident_id", "zone").select("incident_id", "zone")


@query(
    "C17_radius_search",
    f"SELECT service_id, round(k, 6) AS km FROM (SELECT service_id, {dist('slat', 'slng', '28.57', '77.2')} AS k FROM {SRV}) WHERE k <= 12 ORDER BY k, service_id LIMIT 20",
)
def radius_search(s, d):
    k = geo.haversine(F.col("slat"), F.col("slng"), F.lit(28.57), F.lit(77.2))
    return M.services(s, d).withColumn("k", k).where("k <= 12").orderBy("k", "service_id").limit(20).select("service_id", F.round("k", 6).alias("km"))


@query(
    "C18_blocking_pairs",
    """WITH k AS (SELECT DISTINCT p_partkey, key FROM (SELECT p_partkey, 'pre:' || lower(left(trim(p_name), 4)) AS key FROM part UNION ALL SELECT p_partkey, 'dev:' || p_size || p_brand FROM part)),
  ok AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 60)
  SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM k a JOIN k b ON a.key = b.key AND a.p_partkey < b.p_partkey WHERE a.key IN (SELECT key FROM ok)""",
)
def blocking_pairs(s, d):
    keys = F.array_distinct(F.array(F.concat(F.lit("pre:"), F.lower(F.substring(F.trim("p_name"), 1, 4))), F.concat(F.lit("dev:"), F.col("p_size").cast("string"), F.col("p_brand"))))
    k = M.table(s, d, "part").select("p_partkey", F.explode(keys).alias("key"))
    k = k.join(k.groupBy("key").agg(F.count("*").alias("n")).where("n between 2 and 60").select("key"), "key", "left_semi")
    return k.select("key", F.col("p_partkey").alias("a")).join(k.select("key", F.col("p_partkey").alias("b")), "key").where("a < b").select("a", "b").distinct()


@query("C19_two_hop", f"WITH {LIVE} SELECT x.u AS a, y.u AS b, count(*) AS shared FROM adj x JOIN adj y ON x.v = y.v AND x.u < y.u WHERE NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = x.u AND z.v = y.u) GROUP BY 1, 2")
def two_hop_pairs(s, d):
    return graph.pair_sums(_adj(s, d))


@query(
    "C23_case_counts",
    "SELECT c_mktsegment AS case_id, count(*) AS n_entities, coalesce(sum(n), 0)::BIGINT AS n_orders, count(n) AS n_with_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1",
)
def case_counts(s, d):
    n = M.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return M.table(s, d, "customer").join(n, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("case_id")).agg(F.count("*").alias("n_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.count("n").alias("n_with_orders"))


# ---- aggregates


@query(
    "D01_counters",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE priority = 'CRITICAL') AS critical, count(*) FILTER (WHERE lat IS NULL) AS unlocated, count(*) FILTER (WHERE hour >= 20 OR hour <= 5) AS night, count(DISTINCT subject) AS subjects, max(incident_id) AS last_id FROM {INC}",
)
def counters(s, d):
    return M.incidents(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("priority") == "CRITICAL").alias("critical"), F.count_if(F.col("lat").isNull()).alias("unlocated"), F.count_if((F.col("hour") >= 20) | (F.col("hour") <= 5)).alias("night"), F.count_distinct("subject").alias("subjects"), F.max("incident_id").alias("last_id"))


@query("D03_grouped_counts", f"SELECT type, priority, count(*) AS n FROM {INC} GROUP BY ALL ORDER BY n DESC, type, priority")
def grouped_counts(s, d):
    return M.incidents(s, d).groupBy("type", "priority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "priority")


@query("D05_by_hour", f"SELECT hour, count(*) AS n FROM {INC} GROUP BY hour ORDER BY hour")
def by_hour(s, d):
    return M.incidents(s, d).groupBy("hour").agg(F.count("*").alias("n")).orderBy("hour")


@query(
    "D08_endpoint_activity",
    f"""WITH r AS {ALL_REL}, e AS (SELECT src AS uid, dst AS other, * FROM r WHERE status <> 'REJECTED' UNION ALL SELECT dst, src, * FROM r WHERE status <> 'REJECTED')
  SELECT uid, count(*) AS interactions, count(*) FILTER (WHERE type = 'TRANSFERRED_MONEY') AS payments, round(coalesce(sum(amount) FILTER (WHERE type = 'TRANSFERRED_MONEY'), 0), 2) AS paid,
    count(DISTINCT other) AS others, min(rid) AS first_rid,
    round(CASE WHEN count(*) >= 2 THEN count(*) FILTER (WHERE seen_at >= TIMESTAMP '1998-01-01' - INTERVAL 45 DAY)::DOUBLE / count(*) ELSE 0.2 END, 6) AS recency FROM e GROUP BY uid""",
)
def activity(s, d):
    out = scoring.endpoint_activity(M.all_relations(s, d), "1998-01-01 00:00:00")
    return out.select("uid", "interactions", "payments", F.round("paid", 2).alias("paid"), "others", "first_rid", F.round("recency", 6).alias("recency"))


@query("D12_having", f"SELECT device, count(*) AS n, count(DISTINCT zone_id) AS zones, count(DISTINCT CAST(seen_at AS DATE)) AS days FROM {INC} WHERE device IS NOT NULL GROUP BY device HAVING count(*) >= 3")
def having(s, d):
    g = M.incidents(s, d).where("device is not null").groupBy("device").agg(F.count("*").alias("n"), F.count_distinct("zone_id").alias("zones"), F.count_distinct(F.to_date("seen_at")).alias("days"))
    return g.where("n >= 3")


@query(
    "D14_nested_lists",
    f"SELECT src AS uid, string_agg(rid::VARCHAR, ',' ORDER BY confidence DESC, rid) AS rids FROM {ALL_REL} GROUP BY src",
)
def nested_lists(s, d):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "rid")))
    return M.all_relations(s, d).groupBy(F.col("src").alias("uid")).agg(F.array_join(F.transform(rows, lambda r: r["rid"].cast("string")), ",").alias("rids"))


@query("D15_status_counts", f"SELECT src AS uid, count(*) FILTER (WHERE status = 'OBSERVED') AS observed, count(*) FILTER (WHERE status = 'INFERRED') AS inferred, round(avg(confidence), 6) AS mean FROM {ALL_REL} GROUP BY src")
def status_counts(s, d):
    return M.all_relations(s, d).groupBy(F.col("src").alias("uid")).agg(F.count_if(F.col("status") == "OBSERVED").alias("observed"), F.count_if(F.col("status") == "INFERRED").alias("inferred"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("D18_best_edge", f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(rid, (confidence, -rid)) AS rid, max(confidence) AS confidence FROM {ALL_REL} GROUP BY 1, 2")
def best_edge(s, d):
    return M.all_relations(s, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("rid", F.struct("confidence", -F.col("rid"))).alias("rid"), F.max("confidence").alias("confidence"))


@query(
    "D19_growth",
    f"WITH t AS (SELECT type, count(*) AS total, count(*) FILTER (WHERE seen_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 7 DAY) AS recent FROM {INC} GROUP BY type) SELECT type, total, recent, CASE WHEN total - recent <= 0 OR recent = 0 THEN NULL ELSE round(recent * 100.0::DOUBLE / (total - recent), 1) END AS growth FROM t",
)
def growth(s, d):
    late = F.col("seen_at") >= F.lit(M.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))
    g = M.incidents(s, d).groupBy("type").agg(F.count("*").alias("total"), F.count_if(late).alias("recent"))
    prior = F.col("total") - F.col("recent")
    return g.withColumn("growth", F.when((prior > 0) & (F.col("recent") > 0), F.round(F.col("recent") * 100.0 / prior, 1)))


@query("D20_density", f"WITH {ALL_LIVE} SELECT (SELECT count(*) FROM act) AS nodes, (SELECT count(*) FROM live) AS edges, round(2 * (SELECT count(*) FROM live)::DOUBLE / greatest(1, (SELECT count(*) FROM act) * ((SELECT count(*) FROM act) - 1)), 6) AS density")
def density(s, d):
    n, e = _all_nodes(s, d).agg(F.count("*").alias("nodes")), _all_live(s, d).agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.round(2 * F.col("edges") / F.greatest(F.lit(1), F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"))


@query(
    "D21_dashboard",
    f"""WITH i AS {INC}, r AS {ALL_REL} SELECT (SELECT count(*) FROM customer) AS persons, (SELECT count(*) FROM supplier) AS organisations, (SELECT count(*) FROM i) AS incidents, (SELECT count(*) FROM i WHERE priority = 'CRITICAL') AS critical,
  (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM r WHERE status = 'INFERRED') AS inferred, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS open_orders""",
)
def dashboard(s, d):
    one = [
        M.table(s, d, "customer").agg(F.count("*").alias("persons")),
        M.table(s, d, "supplier").agg(F.count("*").alias("organisations")),
        M.incidents(s, d).agg(F.count("*").alias("incidents"), F.count_if(F.col("priority") == "CRITICAL").alias("critical")),
        M.all_relations(s, d).agg(F.count("*").alias("relations"), F.count_if(F.col("status") == "INFERRED").alias("inferred")),
        M.table(s, d, "orders").agg(F.count_if(F.col("o_orderstatus") != "F").alias("open_orders")),
    ]
    out = one[0]
    for frame in one[1:]:  # frames of one row
        out = out.crossJoin(frame)
    return out


# ---- ranks and windows


@query("E01_percentile_rank", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) - 1)::DOUBLE / count(*) OVER (), 6) AS r FROM customer")
def percentile(s, d):
    return ranking.percentile_rank(M.table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "r").select("c_custkey", F.round("r", 6).alias("r"))


@query("E03_top_per_group", "SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 8")
def top_members(s, d):
    t = scoring.top_per_group(M.table(s, d, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.col("c_custkey")], 8)
    return t.select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


@query("E04_latest_per_key", f"SELECT subject, max(incident_id) AS incident_id FROM (SELECT subject, incident_id, row_number() OVER (PARTITION BY subject ORDER BY seen_at DESC, incident_id DESC) AS p FROM {INC}) WHERE p = 1 GROUP BY subject")
def latest_per_key(s, d):
    return M.incidents(s, d).groupBy("subject").agg(F.max(F.struct("seen_at", "incident_id")).alias("last")).select("subject", F.col("last.incident_id").alias("incident_id"))


@query(
    "E07_escalation",
    f"""WITH t AS (SELECT subject, list_sort(list(epoch(seen_at)::BIGINT)) AS t FROM {INC} GROUP BY subject),
  x AS (SELECT subject, len(t) AS n, t[len(t)] - t[len(t) // 2 + 1] AS late, t[len(t) // 2 + 1] - t[1] AS early FROM t)
  SELECT subject, n::BIGINT AS n, n >= 3 AND (CASE WHEN late // 86400 = 0 THEN 1 ELSE late // 86400 END) < (CASE WHEN early // 86400 = 0 THEN 1 ELSE early // 86400 END) AS escalating FROM x""",
)
def escalation(s, d):
    t = M.incidents(s, d).groupBy("subject").agg(F.array_sort(F.collect_list(F.unix_seconds(F.col("seen_at").cast("timestamp")))).alias("t"))
    n = F.size("t")
    mid = F.element_at("t", (F.floor(n / 2) + 1).cast("int"))
    days = lambda x: F.when(F.floor(x / 86_400) == 0, 1).otherwise(F.floor(x / 86_400))
    return t.select("subject", n.cast("long").alias("n"), ((n >= 3) & (days(F.element_at("t", -1) - mid) < days(mid - F.element_at("t", 1)))).alias("escalating"))


@query("E09_share_of_peak", f"WITH t AS (SELECT type, count(*) AS n FROM {INC} GROUP BY type) SELECT type, round(n::DOUBLE / max(n) OVER (), 6) AS share FROM t")
def share_of_peak(s, d):
    t = M.incidents(s, d).groupBy("type").agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(t.agg(F.max("n").alias("peak")))).select("type", F.round(F.col("n") / F.col("peak"), 6).alias("share"))


@query("E10_sequence", f"SELECT incident_id, 'INC-' || lpad((row_number() OVER (ORDER BY seen_at, incident_id))::VARCHAR, 6, '0') AS ref FROM {INC}")
def sequence(s, d):
    return ranking.numbered(M.incidents(s, d).select("incident_id", "seen_at"), ["seen_at", "incident_id"]).select("incident_id", F.concat(F.lit("INC-"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("ref"))


# ---- order and paging


@query("F01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(s, d):
    return M.table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("F02_page", f"SELECT incident_id, type FROM {INC} WHERE priority = 'HIGH' ORDER BY seen_at DESC, incident_id LIMIT 20 OFFSET 40")
def page(s, d):
    return M.incidents(s, d).where("priority = 'HIGH'").orderBy(F.desc("seen_at"), "incident_id").offset(40).limit(20).select("incident_id", "type")


@query("F03_nulls_last", f"SELECT incident_id, lat FROM {INC} ORDER BY lat DESC NULLS LAST, incident_id LIMIT 30")
def nulls_last(s, d):
    return M.incidents(s, d).orderBy(F.desc_nulls_last("lat"), "incident_id").limit(30).select("incident_id", "lat")


@query("F07_limit_then_rank", f"SELECT incident_id, priority FROM (SELECT * FROM {INC} ORDER BY seen_at DESC, incident_id LIMIT 50) ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END, seen_at, incident_id LIMIT 20")
def limit_then_rank(s, d):
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).when(F.col("priority") == "LOW", 3).otherwise(9)
    return M.incidents(s, d).orderBy(F.desc("seen_at"), "incident_id").limit(50).orderBy(rank, "seen_at", "incident_id").limit(20).select("incident_id", "priority")


@query("F12_merged_queues", f"SELECT * FROM ((SELECT rid AS id, 'relation' AS kind, confidence FROM {ALL_REL} WHERE status = 'INFERRED' ORDER BY confidence DESC, rid LIMIT 6) UNION ALL (SELECT incident_id, 'incident', 0.8::DOUBLE FROM {INC} WHERE priority = 'CRITICAL' ORDER BY seen_at DESC, incident_id LIMIT 6)) ORDER BY confidence DESC, kind, id LIMIT 6")
def merged_queues(s, d):
    a = M.all_relations(s, d).where("status = 'INFERRED'").orderBy(F.desc("confidence"), "rid").limit(6).select(F.col("rid").alias("id"), F.lit("relation").alias("kind"), "confidence")
    b = M.incidents(s, d).where("priority = 'CRITICAL'").orderBy(F.desc("seen_at"), "incident_id").limit(6).select("incident_id", F.lit("incident"), F.lit(0.8))
    return a.union(b).orderBy(F.desc("confidence"), "kind", "id").limit(6)


# ---- sets and duplicates


@query("G01_set_union", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_union(s, d):
    return M.table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).union(M.table(s, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("G02_set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_intersection(s, d):
    return M.table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).intersect(M.table(s, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("G03_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(s, d):
    return M.table(s, d, "customer").select(F.col("c_custkey").alias("k")).join(M.table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("G05_content_duplicates", "SELECT doc_id, sha256(text) AS content_hash, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def content_duplicates(s, d):
    t = M.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = t.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return t.join(first, "content_hash").select("doc_id", "content_hash", (F.col("doc_id") != F.col("first")).alias("is_duplicate"))


@query("G08_canonical_pairs", f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {ALL_REL}")
def canonical_pairs(s, d):
    return M.all_relations(s, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


# ---- scalar functions


@query(
    "H01_normal_forms",
    r"""SELECT c_custkey, lower(regexp_replace(c_name, '[\s#-]', '', 'g')) AS compact, regexp_replace(lower(trim(regexp_replace(c_name, '\s+', ' ', 'g'))), '\.+$', '') AS plain,
  substr('91' || lpad(c_custkey::VARCHAR, 10, '9'), 3) AS phone FROM customer""",
)
def normal_forms(s, d):
    phone = F.concat(F.lit("+91-"), F.lpad(F.col("c_custkey").cast("string"), 10, "9"))
    return M.table(s, d, "customer").select("c_custkey", F.lower(F.regexp_replace("c_name", r"[\s#-]", "")).alias("compact"), X.normal_name(F.col("c_name")).alias("plain"), X.normal_phone(phone).alias("phone"))


@query(
    "H05_safe_cells",
    "WITH v AS (SELECT s_suppkey, (['=', '+', '-', '@', 'x'])[(s_suppkey % 5 + 1)::INT] || s_name AS v FROM supplier) SELECT s_suppkey, CASE WHEN left(v, 1) IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS cell FROM v",
)
def safe_cells(s, d):
    marks = F.array(*map(F.lit, ["=", "+", "-", "@", "x"]))
    return M.table(s, d, "supplier").select("s_suppkey", X.safe_cell(F.concat(marks[(F.col("s_suppkey") % 5).cast("int")], F.col("s_name"))).alias("cell"))


@query("H07_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates(s, d):
    t = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "dd/MM/yyyy")).otherwise(F.date_format(t, "dd-MM-yyyy"))
    return M.table(s, d, "orders").select("o_orderkey", F.date_format(X.any_date(shown), "yyyy-MM-dd").alias("day"))


@query(
    "H12_name_similarity",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND left(a.name, 2) = left(b.name, 2)),
  j AS (SELECT a, b, jaro_similarity(a, b) AS j, CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3 ELSE 2 END AS prefix FROM p)
  SELECT a, b, levenshtein(a, b)::INTEGER AS edits, round(j + prefix * 0.1::DOUBLE * (1 - j), 4) AS jaro_winkler, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 4) AS edit_ratio FROM j""",
)
def name_similarity(s, d):
    n = M.table(s, d, "part").select("p_name").distinct().withColumn("block", F.substring("p_name", 1, 2))
    p = n.select("block", F.col("p_name").alias("a")).join(n.select("block", F.col("p_name").alias("b")), "block").where("a < b")
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", F.levenshtein(a, b).alias("edits"), F.round(X.jaro_winkler(a, b), 4).alias("jaro_winkler"), F.round(X.edit_ratio(a, b), 4).alias("edit_ratio"))


@query("H16_haversine", f"SELECT service_id, round({dist('slat', 'slng', '28.6', '77.1')}, 6) AS km FROM {SRV}")
def distances(s, d):
    return M.services(s, d).select("service_id", F.round(geo.haversine(F.col("slat"), F.col("slng"), F.lit(28.6), F.lit(77.1)), 6).alias("km"))


@query("H36_emails", r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'))::BIGINT AS emails, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents")
def emails(s, d):
    email = next(p for k, p, c in extraction.RECOGNISERS if c == 0.90 and k == "social")
    return M.table(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(email), F.lit(0))).cast("long").alias("emails"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"))


# ---- graph


@query(
    "I02_k_hop",
    f"""WITH RECURSIVE {LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 5),
  walk AS (SELECT u AS start, u AS node, 0 AS hop FROM hub UNION SELECT start, adj.v, hop + 1 FROM walk JOIN adj ON adj.u = node WHERE hop < 3)
  SELECT start, node, min(hop)::INTEGER AS hop FROM walk GROUP BY start, node""",
)
def k_hop(s, d):
    adj = _adj(s, d)
    return graph.k_hop(adj, _top(adj, 5).withColumnRenamed("uid", "start"), 3)


@query(
    "I04_simple_paths",
    f"""WITH RECURSIVE {LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 6), pair AS (SELECT a.u AS src, b.u AS dst FROM hub a JOIN hub b ON a.u < b.u),
  walk AS (SELECT src, dst, [src] AS path FROM pair UNION ALL SELECT src, dst, list_append(path, adj.v) FROM walk JOIN adj ON adj.u = path[len(path)] WHERE len(path) <= 4 AND path[len(path)] <> dst AND NOT list_contains(path, adj.v))
  SELECT src, dst, array_to_string(path, '>') AS path FROM walk WHERE path[len(path)] = dst""",
)
def simple_paths(s, d):
    adj = _adj(s, d)
    return graph.simple_paths(adj, _hub_pairs(adj, 6), 4).select("src", "dst", F.array_join("path", ">").alias("path"))


@query("I05_common_neighbours", f"WITH {LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 40) SELECT x.u AS a, y.u AS b, x.v AS shared FROM adj x JOIN adj y ON x.v = y.v AND x.u < y.u WHERE x.u IN (SELECT u FROM hub) AND y.u IN (SELECT u FROM hub)")
def common_neighbours(s, d):
    adj = _adj(s, d)
    ends = adj.join(_top(adj, 40).withColumnRenamed("uid", "u"), "u", "left_semi")
    return ends.select(F.col("v").alias("shared"), F.col("u").alias("a")).join(ends.select(F.col("v").alias("shared"), F.col("u").alias("b")), "shared").where("a < b").select("a", "b", "shared")


@query("I06_degree", f"WITH {LIVE} SELECT a.uid, coalesce(degree, 0)::BIGINT AS degree, coalesce(weighted, 0)::BIGINT AS weighted, round(coalesce(degree, 0)::DOUBLE / ((SELECT count(*) FROM act) - 1), 8) AS centrality FROM act a LEFT JOIN deg ON a.uid = deg.u")
def degree(s, d):
    return graph.degrees(_nodes(s, d), _adj(s, d)).select("uid", "degree", "weighted", F.round("centrality", 8).alias("centrality"))


@query(
    "I07_betweenness",
    f"""WITH RECURSIVE {SEARCH},
  back(hop, source, node, paths, delta) AS (SELECT max(hop) + 1, NULL::VARCHAR, NULL::VARCHAR, 1.0::DOUBLE, 0.0::DOUBLE FROM found
    UNION ALL SELECT f.hop, f.source, f.node, f.paths, coalesce(f.paths * sum((1 + b.delta) / b.paths), 0) FROM (SELECT DISTINCT hop FROM back) k JOIN found f ON f.hop = k.hop - 1
      LEFT JOIN adj ON adj.u = f.node LEFT JOIN back b ON b.source = f.source AND b.node = adj.v GROUP BY f.hop, f.source, f.node, f.paths),
  sums AS (SELECT node, sum(delta) AS delta FROM back WHERE hop > 0 GROUP BY node)
  SELECT deg.u AS uid, round(coalesce(delta, 0) / 2 * CASE WHEN n > 2 THEN 2 / ((n - 1.0::DOUBLE) * (n - 2)) ELSE 1 END, 8) AS betweenness
  FROM deg CROSS JOIN size LEFT JOIN sums ON sums.node = deg.u""",
)
def betweenness(s, d):
    adj = _adj(s, d)
    nodes = adj.select(F.col("u").alias("uid")).distinct()
    return graph.betweenness(nodes, adj).select("uid", F.round("betweenness", 8).alias("betweenness"))


@query(
    "I08_closeness",
    f"""WITH RECURSIVE {SEARCH}, sums AS (SELECT node, count(*)::DOUBLE AS r, sum(hop)::DOUBLE AS d FROM found WHERE hop > 0 GROUP BY node)
  SELECT deg.u AS uid, round(coalesce(r / d * (r / greatest(n - 1, 1)), 0), 8) AS closeness FROM deg CROSS JOIN size LEFT JOIN sums ON sums.node = deg.u""",
)
def closeness(s, d):
    adj = _adj(s, d)
    nodes = adj.select(F.col("u").alias("uid")).distinct()
    return graph.closeness(nodes, adj).select("uid", F.round("closeness", 8).alias("closeness"))


@query(
    "I10_components",
    f"""WITH RECURSIVE {LIVE},
  label AS (SELECT DISTINCT u AS node, u AS component, TRUE AS moving FROM adj
    UNION ALL SELECT node, component, bool_or(moved) OVER () FROM (
      SELECT node, min(component) AS component, min(component) < max(own) AS moved FROM (
        SELECT node, component, component AS own, moving FROM label UNION ALL SELECT adj.v, component, NULL, moving FROM label JOIN adj ON adj.u = node) WHERE moving GROUP BY node)),
  last AS (SELECT node, min(component) AS component FROM label GROUP BY node)
  SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM last""",
)
def connected(s, d):
    found = components(_live(s, d).select("src", "dst"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


@query("I12_communities")
def communities(s, d):
    return graph.compact(graph.modularity_communities(_adj(s, d), graph.WHOLE_GRAPH))


@query(
    "I14_modularity",
    f"""WITH {LIVE}, lab AS (SELECT uid, hash_key % 7 AS c FROM (SELECT uid, CAST(substr(uid, 2) AS BIGINT) AS hash_key FROM act)),
  e AS (SELECT n, a.c AS cu, b.c AS cv FROM adj JOIN lab a ON a.uid = adj.u JOIN lab b ON b.uid = adj.v),
  g AS (SELECT cu, sum(n)::DOUBLE AS t, coalesce(sum(n) FILTER (WHERE cu = cv), 0)::DOUBLE AS i FROM e GROUP BY cu) SELECT round(sum(i) / sum(t) - sum(t * t) / (sum(t) * sum(t)), 8) AS modularity FROM g""",
)
def modularity(s, d):
    labels = _nodes(s, d).select(F.col("uid").alias("node"), (F.substring("uid", 2, 20).cast("long") % 7).alias("community"))
    return graph.modularity(_adj(s, d), labels).select(F.round("modularity", 8).alias("modularity"))


@query(
    "I15_adamic_adar",
    f"WITH {LIVE} SELECT x.u AS a, y.u AS b, count(*) AS shared, round(sum(CASE WHEN degree > 1 THEN 1 / ln(degree) ELSE 0 END), 6) AS score FROM adj x JOIN adj y ON x.v = y.v AND x.u < y.u JOIN deg ON deg.u = x.v WHERE NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = x.u AND z.v = y.u) GROUP BY 1, 2",
)
def adamic_adar(s, d):
    return graph.adamic_adar(_adj(s, d)).select("a", "b", "shared", F.round("score", 6).alias("score"))


@query("I18_neighbourhood", f"WITH RECURSIVE {ALL_LIVE}, hub AS (SELECT u FROM deg ORDER BY degree DESC, u LIMIT 1), walk AS (SELECT u AS node, 0 AS hop FROM hub UNION SELECT adj.v, hop + 1 FROM walk JOIN adj ON adj.u = node WHERE hop < 2) SELECT rid, src, dst, status FROM live WHERE src IN (SELECT node FROM walk) AND dst IN (SELECT node FROM walk)")
def neighbourhood(s, d):
    live = stored(_all_live(s, d).select("rid", "src", "dst", "status"), "live")
    adj = stored(graph.adjacency(live), "all_adjacency")
    hub = stored(_top(adj, 1).withColumnRenamed("uid", "start"), "hub")
    near = stored(graph.k_hop(adj, hub, 2), "near")
    return graph.induced(live, near.select(F.col("node").alias("uid"))).select("rid", "src", "dst", "status")


@query(
    "I27_explained_path",
    f"""WITH RECURSIVE {paths_sql(6, 6)},
  step AS (SELECT src, dst, path, unnest(range(1, len(path)))::INTEGER AS hop FROM path WHERE node = dst),
  best AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, rid, status FROM live QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY confidence DESC, rid) = 1),
  hop AS (SELECT src, dst, hop, path[hop] AS a, path[hop + 1] AS b FROM step)
  SELECT src, dst, hop, a, b, rid, status, bool_and(status = 'OBSERVED') OVER (PARTITION BY src, dst) AS all_observed FROM hop JOIN best ON x = least(a, b) AND y = greatest(a, b)""",
)
def explained_path(s, d):
    adj = _adj(s, d)
    return graph.explained(_live(s, d), graph.shortest_paths(adj, _hub_pairs(adj, 6), 6))


# ---- text and resolution


@query("J01_extraction")
def extracted(s, d):
    docs = spread(M.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), extraction.TASKS)
    found = extraction.entities_in(docs)
    return extraction.exploded(found, F.col("spans"), "s", "id").select("id", "s.text", "s.kind", "s.start", "s.stop", "s.confidence")


@query("J10_relations", f"SELECT id, source, type, target, confidence, trigger_start::INTEGER AS trigger_start, NULL::VARCHAR AS source_uid, NULL::VARCHAR AS target_uid FROM ({M.NARRATIVE_FACTS_SQL})")
def extracted_relations(s, d):
    return extraction.relations_in(extraction.entities_in(spread(M.narratives(s, d).select("id", "text"), extraction.TASKS)))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Parts as records to resolve: names recur, brands are identifiers."""
    part = M.table(s, d, "part")
    near = M.relations(s, d).groupBy(F.col("dst").alias("uid")).agg(F.collect_set("src").alias("neighbours"))
    own = part.select(M.uid("p", "p_partkey").alias("uid"), F.lit("vehicle").alias("type"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.create_map(F.lit("device_id"), F.concat_ws("/", "p_brand", "p_size", "p_type")).alias("attributes"), F.array("p_type").alias("cases"))
    return own.join(near, "uid", "left")


@query("K13_resolution_queue")
def resolution_queue(s, d):
    return resolution.proposals(_records(s, d)).select("a", "b", "score", F.size("factors").cast("long").alias("n_factors"))


# ---- places, patterns, scores


@query(
    "L01_heatmap",
    f"""WITH i AS {INC}, z AS {ZON}, w AS (SELECT *, CASE priority WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 2.0 WHEN 'HIGH' THEN 3.5 ELSE 5.0 END AS weight FROM i WHERE seen_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 90 DAY),
  k AS (SELECT z.zone_id, weight, pow(2.71828, -pow(dd / greatest(radius, 0.2), 2)) AS k FROM (SELECT w.weight, z.zone_id, z.radius, {dist('lat', 'lng', 'zlat', 'zlng')} AS dd FROM w JOIN z ON lat IS NOT NULL) z WHERE dd <= radius * 1.5
    UNION ALL SELECT zone_id, weight, 1.0 FROM w WHERE lat IS NULL),
  s AS (SELECT zone_id, sum(weight * k) AS weighted, count(*) FILTER (WHERE k > 0.25) AS incidents FROM k GROUP BY zone_id),
  o AS (SELECT z.zone_id, z.zone, coalesce(incidents, 0)::BIGINT AS incidents, coalesce(weighted, 0) / greatest(0.35, 3.14159 * radius * radius) AS density FROM z LEFT JOIN s ON s.zone_id = z.zone_id),
  p AS (SELECT *, density / max(density) OVER () AS share FROM o)
  SELECT zone_id, zone, incidents, round(density, 3) AS density, round(share, 3) AS share, CASE WHEN share >= 0.75 THEN 'RED' WHEN share >= 0.45 THEN 'ORANGE' WHEN share >= 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS band,
    CASE WHEN density >= 12 THEN 'RED' WHEN density >= 6 THEN 'ORANGE' WHEN density >= 2 THEN 'YELLOW' ELSE 'GREEN' END AS absolute_band FROM p""",
)
def heatmap(s, d):
    recent_ones = M.incidents(s, d).where(F.col("seen_at") >= F.lit(M.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(90)))
    h = places.heatmap(recent_ones, M.zones(s, d), M.WEIGHTS)
    return h.select("zone_id", "zone", "incidents", F.round("density", 3).alias("density"), F.round("share", 3).alias("share"), "band", "absolute_band")


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring zone centres on the grid."""
    z = M.zones(s, d)
    a = z.select(F.col("zone_id").alias("u"), F.col("zlat").alias("alat"), F.col("zlng").alias("alng"))
    b = z.select(F.col("zone_id").alias("v"), F.col("zlat").alias("blat"), F.col("zlng").alias("blng"))
    step = a.withColumn("v", F.explode(F.array(F.when(F.col("u") % 5 < 4, F.col("u") + 1), F.when(F.col("u") < 20, F.col("u") + 5)))).where("v is not null")
    return step.join(b, "v").withColumn("seg", F.concat_ws("-", "u", "v"))


@query(
    "L02_segment_pressure",
    f"""WITH z AS {ZON}, seg AS (SELECT a.zone_id || '-' || b.zone_id AS seg, (a.zlat + b.zlat) / 2 AS mlat, (a.zlng + b.zlng) / 2 AS mlng, {dist('a.zlat', 'a.zlng', 'b.zlat', 'b.zlng')} AS km
    FROM z a JOIN z b ON (b.zone_id = a.zone_id + 1 AND a.zone_id % 5 < 4) OR b.zone_id = a.zone_id + 5),
  n AS (SELECT seg, CASE priority WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 2.0 WHEN 'HIGH' THEN 3.5 ELSE 5.0 END AS weight, {dist('lat', 'lng', 'mlat', 'mlng')} AS dd FROM {INC} i JOIN seg ON lat IS NOT NULL),
  p AS (SELECT seg, sum(weight * (1 - dd / 0.6)) AS pressure FROM n WHERE dd <= 0.6 GROUP BY seg),
  v AS (SELECT seg, min({dist('mlat', 'mlng', 'slat', 'slng')}) AS service_km FROM seg JOIN {SRV} ON TRUE GROUP BY seg)
  SELECT seg.seg, round(km, 4) AS km, round(coalesce(pressure, 0), 4) AS pressure, round(coalesce(service_km, 5.0), 4) AS service_km FROM seg LEFT JOIN p ON p.seg = seg.seg LEFT JOIN v ON v.seg = seg.seg""",
)
def segment_pressure(s, d):
    m = places.segment_metrics(_segments(s, d), M.incidents(s, d), M.services(s, d), M.WEIGHTS)
    return m.select("seg", F.round("km", 4).alias("km"), F.round("pressure", 4).alias("pressure"), F.round("service_km", 4).alias("service_km"))


@query(
    "L05_routes",
    f"""WITH RECURSIVE z AS {ZON}, half AS (SELECT a.zone_id AS u, b.zone_id AS v, (a.zlat + b.zlat) / 2 AS mlat, (a.zlng + b.zlng) / 2 AS mlng, {dist('a.zlat', 'a.zlng', 'b.zlat', 'b.zlng')} AS km
    FROM z a JOIN z b ON (b.zone_id = a.zone_id + 1 AND a.zone_id % 5 < 4) OR b.zone_id = a.zone_id + 5),
  n AS (SELECT u, v, CASE priority WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 2.0 WHEN 'HIGH' THEN 3.5 ELSE 5.0 END AS weight, {dist('lat', 'lng', 'mlat', 'mlng')} AS dd FROM {INC} i JOIN half ON lat IS NOT NULL),
  p AS (SELECT u, v, sum(weight * (1 - dd / 0.6)) AS pressure FROM n WHERE dd <= 0.6 GROUP BY ALL),
  c AS (SELECT u, v, min({dist('mlat', 'mlng', 'slat', 'slng')}) AS service_km FROM half JOIN {SRV} ON TRUE GROUP BY ALL),
  m AS (SELECT u, v, km, km * 1.45::DOUBLE * (1 + 0.22::DOUBLE * coalesce(pressure, 0)) * CASE WHEN u % 4 = 0 THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN v % 7 = 0 THEN 1.25::DOUBLE ELSE 1 END + 0.12::DOUBLE * coalesce(service_km, 5.0) AS w
    FROM half LEFT JOIN p USING (u, v) LEFT JOIN c USING (u, v)),
  seg AS (SELECT u::VARCHAR AS u, v::VARCHAR AS v, km, w FROM m UNION ALL SELECT v::VARCHAR, u::VARCHAR, km, w FROM m),
  walk AS (SELECT src, dst, [src] AS path, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS km FROM (VALUES ('0', '7'), ('3', '15')) t(src, dst)
    UNION ALL SELECT src, dst, list_append(path, seg.v), cost + w, walk.km + seg.km FROM walk JOIN seg ON seg.u = path[len(path)] WHERE path[len(path)] <> dst AND NOT list_contains(path, seg.v)),
  best AS (SELECT *, round(greatest(5.0, least(97.0, 100 - (cost / greatest(km, 0.05) - 1) * 26)), 1)::DOUBLE AS score FROM walk WHERE path[len(path)] = dst
    QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY cost, len(path), path) <= 3),
  placed AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, cost, path)::INTEGER AS rank FROM best)
  SELECT src, dst, array_to_string(path, '>') AS path, round(cost, 4) AS cost, round(km, 4) AS km, score, rank, rank = 1 AS recommended FROM placed""",
)
def routes(s, d):
    m = places.segment_metrics(_segments(s, d), M.incidents(s, d), M.services(s, d), M.WEIGHTS)
    m = m.withColumn("w", places.segment_cost(F.lit(21), F.col("u") % 4 == 0, F.col("v") % 7 == 0))
    m = stored(m.select(F.col("u").cast("string"), F.col("v").cast("string"), "w", "km"), "segments")
    both = m.union(m.select("v", "u", "w", "km"))
    pairs = s.createDataFrame([("0", "7"), ("3", "15")], "src string, dst string")
    return places.ranked_routes(graph.cheapest_paths(both, pairs, 3, F.col("w")), both).select("src", "dst", F.array_join("path", ">").alias("path"), F.round("cost", 4).alias("cost"), F.round("km", 4).alias("km"), "score", "rank", "recommended")


@query(
    "M05_findings",
    f"""WITH i AS {INC}, v AS (SELECT 'shared_vehicle' AS kind, upper(replace('KA ' || (subject % 97), ' ', '')) AS descriptor, count(*) AS n, least(0.88, 0.45 + 0.13 * count(*) + 0.05 * count(DISTINCT zone_id)) AS confidence FROM i GROUP BY 2 HAVING count(*) >= 2
  UNION ALL SELECT 'shared_device', device::VARCHAR, count(*), least(0.85, 0.45 + 0.14 * count(*)) FROM i WHERE device IS NOT NULL GROUP BY 2 HAVING count(*) >= 2
  UNION ALL SELECT 'location_concentration', zone_id::VARCHAR, count(*), least(0.80, 0.35 + 0.11 * count(*)) FROM i GROUP BY 2 HAVING count(*) >= 3
  UNION ALL SELECT 'common_subject', subject::VARCHAR, count(*), least(0.82, 0.40 + 0.10 * count(*)) FROM i GROUP BY 2 HAVING count(*) >= 3)
  SELECT kind, descriptor, n, round(confidence::DOUBLE, 6) AS confidence FROM v""",
)
def findings(s, d):
    vehicle = F.concat(F.lit("KA "), (F.col("subject") % 97).cast("string"))
    f = patterns.findings(M.incidents(s, d), vehicle, F.col("device"), F.col("zone_id"), F.col("subject"))
    return f.select("kind", "descriptor", "n", F.round("confidence", 6).alias("confidence"))


@query(
    "M07_repeated_encounters",
    f"""WITH e AS (SELECT subject AS uid, zone_id AS location, CAST(seen_at AS DATE) AS day, min(seen_at) AS t FROM {INC} WHERE priority IN ('HIGH', 'CRITICAL') GROUP BY ALL),
  m AS (SELECT a.uid AS a, b.uid AS b, a.location, a.day FROM e a JOIN e b ON a.location = b.location AND a.day = b.day AND a.uid < b.uid WHERE a.uid % 10 <> b.uid % 10),
  g AS (SELECT a, b, count(*) AS slots, count(DISTINCT location) AS locations, count(DISTINCT day) AS days FROM m GROUP BY a, b)
  SELECT a, b, slots, locations, days FROM g WHERE slots >= 2 AND (locations >= 2 OR days >= 2)""",
)
def repeated_encounters(s, d):
    i = M.incidents(s, d).where(F.col("priority").isin("HIGH", "CRITICAL"))
    linked = (F.col("a") % 10) == (F.col("b") % 10)
    return patterns.repeated_encounters(i.select(F.col("subject").alias("uid"), F.col("zone_id").alias("location"), "seen_at"), linked, 0.0).select("a", "b", "slots", "locations", "days")


@query("N01_priority")
def priority_scores(s, d):
    ent, rel = M.entities(s, d), M.relations(s, d)
    cases = M.table(s, d, "orders").where("o_orderstatus = 'O'").select(M.uid("c", "o_custkey").alias("uid"), F.col("o_orderpriority").alias("case_id"))
    where = M.table(s, d, "customer").select(M.uid("c", "c_custkey").alias("uid"), F.col("c_nationkey").alias("location"))
    sources = graph.centrality_sources(_nodes(s, d))
    p = scoring.priority(ent, rel, cases, where, "1998-01-01 00:00:00", sources)
    return p.select("uid", "score", "band", F.round("confidence", 4).alias("confidence"))


@query(
    "N05_hidden_links",
    f"""WITH {LIVE}, t AS (SELECT x.u AS a, y.u AS b, m.type, d.degree FROM adj x JOIN adj y ON x.v = y.v AND x.u < y.u JOIN ent m ON m.uid = x.v JOIN deg d ON d.u = x.v
    WHERE x.u IN (SELECT uid FROM ent WHERE type IN ('person', 'organization')) AND y.u IN (SELECT uid FROM ent WHERE type IN ('person', 'organization')) AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = x.u AND z.v = y.u)),
  g AS (SELECT a, b, count(*) AS shared, sum(CASE WHEN degree > 1 THEN 1 / ln(degree) ELSE 0 END) AS aa, count(*) FILTER (WHERE type IN ('person', 'organization')) AS people, count(*) FILTER (WHERE type = 'location') AS loc FROM t GROUP BY a, b),
  c AS (SELECT *, least(0.92, 0.30 * least(1, aa / 2) + 0.24 * least(1, people / 2.0) + 0.12 * least(1, loc / 2.0) + 0.16 * least(1, shared / 4.0)) AS confidence FROM g)
  SELECT a, b, shared, round(aa, 6) AS score, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.2""",
)
def hidden_links(s, d):
    return scoring.hidden_links(M.entities(s, d), M.relations(s, d), 0.2).select("a", "b", "shared", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query(
    "N06_search",
    f"SELECT uid, name FROM (SELECT uid, name, CASE WHEN lower(name) = 'customer' THEN 0 WHEN starts_with(lower(name), 'customer') THEN 1 ELSE 2 END AS tier FROM {ENT} WHERE contains(lower(name), 'customer')) ORDER BY tier, length(name), name, uid LIMIT 15",
)
def search(s, d):
    q = "customer"
    n = F.lower("name")
    tier = F.when(n == q, 0).when(n.startswith(q), 1).otherwise(2)
    return M.entities(s, d).where(n.contains(q)).orderBy(tier, F.length("name"), "name", "uid").limit(15).select("uid", "name")


@query("N08_timeline", f"SELECT incident_id, type, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM {INC} WHERE subject = 7 AND type <> 'view' ORDER BY seen_at, incident_id LIMIT 200")
def timeline(s, d):
    own = M.incidents(s, d).where("subject = 7 AND type <> 'view'").orderBy("seen_at", "incident_id").limit(200)
    return own.select("incident_id", "type", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


@query(
    "N11_derived_events",
    f"""WITH e AS {ALL_ENT} SELECT rid, CASE r.type WHEN 'TRANSFERRED_MONEY' THEN 'FINANCIAL' ELSE 'OWNERSHIP' END AS event_type, a.name || ' to ' || b.name AS title FROM {ALL_REL} r JOIN e a ON a.uid = r.src JOIN e b ON b.uid = r.dst""",
)
def derived_events(s, d):
    e = M.all_entities(s, d)
    a, b = e.select(F.col("uid").alias("src"), F.col("name").alias("x")), e.select(F.col("uid").alias("dst"), F.col("name").alias("y"))
    kind = F.when(F.col("type") == "TRANSFERRED_MONEY", "FINANCIAL").otherwise("OWNERSHIP")
    return M.all_relations(s, d).join(a, "src").join(b, "dst").select("rid", kind.alias("event_type"), F.concat("x", F.lit(" to "), "y").alias("title"))


# ---- keyed state


def _calls(s: SparkSession, d: str) -> DataFrame:
    e = M.table(s, d, "events")
    return e.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("seconds"), "event_type", "ts")


@query(
    "O05_rate_limit",
    f"""WITH RECURSIVE {turns_sql('event_type')},
  step AS (SELECT user_id, event_id, i, [seconds] AS recent, TRUE AS accepted FROM turn WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, CASE WHEN len(kept) < 3 THEN list_append(kept, seconds) ELSE kept END, len(kept) < 3
      FROM (SELECT t.*, list_filter(recent, lambda x: x >= t.seconds - 86400) AS kept FROM step JOIN turn t ON t.user_id = step.user_id AND t.i = step.i + 1))
  SELECT event_id, user_id, accepted FROM step""",
)
def rate_limited(s, d):
    return stateful.folded(_calls(s, d).drop("ts"), "user_id", ["seconds", "event_id"], stateful.rate_limit(3, 86_400), "boolean").select("event_id", "user_id", F.col("result").alias("accepted"))


SOS_EVENTS = {"view": "RECEIVED", "click": "ASSIGNED", "signup": "RESPONDING", "purchase": "RESOLVED"}


@query(
    "O06_status_machine",
    machine_sql(SOS_EVENTS, stateful.SOS_CHANGES, "RECEIVED", "event_id, user_id, status, accepted", f"event_type IN {tuple(SOS_EVENTS)}"),
)
def status_changes(s, d):
    names = F.create_map(*(F.lit(x) for pair in SOS_EVENTS.items() for x in pair))
    rows = _calls(s, d).drop("ts").withColumn("status", names[F.col("event_type")]).where("status is not null")
    return stateful.folded(rows, "user_id", ["seconds", "event_id"], stateful.status_machine(stateful.SOS_CHANGES, "RECEIVED"), "boolean").select("event_id", "user_id", "status", F.col("result").alias("accepted"))


@query(
    "O10_lock_out",
    f"""WITH RECURSIVE {turns_sql("event_type NOT IN ('error', 'view', 'click') AS success")},
  step AS (SELECT user_id, event_id, i, CASE WHEN success THEN 0 ELSE 1 END AS failed, 0 AS until, CASE WHEN success THEN 'OK' ELSE 'FAILED' END AS result FROM turn WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, CASE result WHEN 'FAILED' THEN failed + 1 WHEN 'REFUSED' THEN failed ELSE 0 END,
        CASE result WHEN 'ACCOUNT_LOCKED' THEN seconds + 900 WHEN 'REFUSED' THEN until ELSE 0 END, result
      FROM (SELECT t.*, failed, until, CASE WHEN seconds < until THEN 'REFUSED' WHEN success THEN 'OK' WHEN failed >= 4 THEN 'ACCOUNT_LOCKED' ELSE 'FAILED' END AS result
        FROM step s JOIN turn t ON t.user_id = s.user_id AND t.i = s.i + 1))
  SELECT event_id, user_id, result FROM step""",
)
def locked_out(s, d):
    rows = _calls(s, d).drop("ts").withColumn("success", ~F.col("event_type").isin("error", "view", "click"))
    return stateful.folded(rows, "user_id", ["seconds", "event_id"], stateful.lock_out(), "string").select("event_id", "user_id", "result")


# ---- writes


@query(
    "P02_decisions",
    f"WITH r AS {ALL_REL}, dec AS (SELECT l_orderkey * 10 + l_linenumber AS rid, l_shipdate AS decided_at, CASE WHEN l_linestatus = 'O' THEN 'VALIDATED' ELSE 'REJECTED' END AS status FROM lineitem WHERE l_quantity >= 49), l AS (SELECT rid, arg_max(status, (decided_at, status)) AS s FROM dec GROUP BY rid) SELECT r.rid, coalesce(s, status) AS status FROM r LEFT JOIN l ON l.rid = r.rid",
)
def decisions(s, d):
    made = M.table(s, d, "lineitem").where("l_quantity >= 49").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), F.col("l_shipdate").alias("decided_at"), F.when(F.col("l_linestatus") == "O", "VALIDATED").otherwise("REJECTED").alias("status"))
    return writes.decided(M.all_relations(s, d).select("rid", "status"), made, "rid").select("rid", "status")


@query("P03_entity_upsert", "WITH m AS (SELECT DISTINCT lower(trim(p_name)) AS norm FROM part), k AS (SELECT DISTINCT lower(trim(p_name)) AS norm FROM part WHERE p_size > 40) SELECT m.norm, k.norm IS NULL AS created FROM m LEFT JOIN k ON k.norm = m.norm")
def entity_upsert(s, d):
    part = M.table(s, d, "part").select(F.lit("object").alias("type"), F.col("p_name").alias("name"), "p_size")
    known = part.where("p_size > 40").select("type", X.normal_name(F.col("name")).alias("norm")).distinct().withColumn("uid", F.concat(F.lit("known-"), "norm"))
    return writes.upserted_entities(part.select("type", "name"), known, "new-").select("norm", "created")


@query("P06_replace", "SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 ELSE c_acctbal END AS score FROM customer")
def replace_rows(s, d):
    old = M.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score"))
    new = M.table(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 2).alias("score"))
    return writes.replaced(old, new, ["k"])


@query("P08_idempotent_insert", "SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 12 UNION SELECT c_custkey FROM customer WHERE c_nationkey > 8)")
def idempotent_insert(s, d):
    c = M.table(s, d, "customer")
    return writes.idempotent_insert(c.where("c_nationkey < 12").select(F.col("c_custkey").alias("k")), c.where("c_nationkey > 8").select(F.col("c_custkey").alias("k")), ["k"])


# ---- composites


@query(
    "T05_entity_list",
    f"WITH {LIVE} SELECT e.uid, e.name, coalesce(degree, 0)::BIGINT AS degree FROM ent e LEFT JOIN deg ON deg.u = e.uid WHERE e.type = 'person' ORDER BY degree DESC, e.name, e.uid LIMIT 25 OFFSET 25",
)
def entity_list(s, d):
    deg = _adj(s, d).groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("n"))
    e = M.entities(s, d).where("type = 'person'").join(deg, "uid", "left").withColumn("degree", F.coalesce("n", F.lit(0)))
    return e.orderBy(F.desc("degree"), "name", "uid").offset(25).limit(25).select("uid", "name", "degree")


@query(
    "T13_safety_overview",
    f"SELECT 'type' AS facet, type AS value, count(*) AS n FROM {INC} GROUP BY 2 UNION ALL SELECT 'hour', hour::VARCHAR, count(*) FROM {INC} GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM {INC} GROUP BY 2",
)
def safety_overview(s, d):
    facets = F.array(*(F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in ("type", "hour", "priority")))
    return M.incidents(s, d).select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query(
    "T14_status_history",
    f"SELECT subject, incident_id, type, lag(type) OVER (PARTITION BY subject ORDER BY seen_at, incident_id) AS before, row_number() OVER (PARTITION BY subject ORDER BY seen_at, incident_id) AS seq FROM {INC}",
)
def status_history(s, d):
    w = Window.partitionBy("subject").orderBy("seen_at", "incident_id")
    return M.incidents(s, d).select("subject", "incident_id", "type", F.lag("type").over(w).alias("before"), F.row_number().over(w).cast("long").alias("seq"))
