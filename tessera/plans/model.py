"""The case graph's tables as projections of the supplied tables, and the same projections in SQL.

Every formula is over integers or short decimals, so that two engines agree on each value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The date that "recent" is counted back from; an argument wherever it matters.
AS_OF = "2024-01-31 00:00:00"

# fixed values: priority by an event's value, and a priority's weight
PRIORITIES = (("CRITICAL", 200), ("HIGH", 100), ("MEDIUM", 40))
WEIGHTS = {"LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.5, "CRITICAL": 5.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uid(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(uid, type, name, active): customers, suppliers, nations and parts; a customer in debt isn't active."""
    t = lambda n: table(spark, d, n)
    person = t("customer").select(uid("c", "c_custkey").alias("uid"), F.lit("person").alias("type"), F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("active"))
    organisation = t("supplier").select(uid("s", "s_suppkey"), F.lit("organization"), "s_name", F.lit(True))
    place = t("nation").select(uid("n", "n_nationkey"), F.lit("location"), "n_name", F.lit(True))
    vehicle = t("part").select(uid("p", "p_partkey"), F.lit("vehicle"), "p_name", F.lit(True))
    return person.union(organisation).union(place).union(vehicle)


ENTITIES_SQL = """
  SELECT 'c' || c_custkey AS uid, 'person' AS type, c_name AS name, c_acctbal >= 0 AS active FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'organization', s_name, TRUE FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'location', n_name, TRUE FROM nation
  UNION ALL SELECT 'p' || p_partkey, 'vehicle', p_name, TRUE FROM part
"""


def all_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities, and each order as a transaction: the ends of all_relations."""
    o = table(spark, d, "orders")
    return entities(spark, d).union(o.select(uid("o", "o_orderkey"), F.lit("transaction"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.lit(True)))


ALL_ENTITIES_SQL = f"""{ENTITIES_SQL}
  UNION ALL SELECT 'o' || o_orderkey, 'transaction', 'Order ' || o_orderkey, TRUE FROM orders
"""


def _status(n: Column) -> Column:
    return F.when(n % 5 == 4, "REJECTED").when(n % 5 == 3, "INFERRED").otherwise("OBSERVED")


def all_relations(spark: SparkSession, d: str) -> DataFrame:
    """(rid, src, dst, type, status, confidence, seen_at, amount): every order, every line of one, and every residence."""
    t = lambda n: table(spark, d, n)
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    o = F.col("o_orderkey")
    paid = t("orders").select(
        (o * 10).alias("rid"), uid("c", "o_custkey").alias("src"), uid("o", "o_orderkey").alias("dst"), F.lit("TRANSFERRED_MONEY").alias("type"),
        _status(o).alias("status"), ((50 + o * 7 % 50) / 100).alias("confidence"), F.col("o_orderdate").alias("seen_at"), F.col("o_totalprice").alias("amount"),
    )
    supplied = t("lineitem").select((k * 10 + n).alias("rid"), uid("o", "l_orderkey"), uid("s", "l_suppkey"), F.lit("ASSOCIATED_WITH"), _status(n), (50 + (k * 7 + n * 13) % 50) / 100, "l_shipdate", "l_extendedprice")
    none = [F.lit("RESIDES_AT"), F.lit("OBSERVED"), F.lit(0.9), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double")]
    person = t("customer").select(-(F.col("c_custkey") * 2), uid("c", "c_custkey"), uid("n", "c_nationkey"), *none)
    firm = t("supplier").select(-(F.col("s_suppkey") * 2 + 1), uid("s", "s_suppkey"), uid("n", "s_nationkey"), *none)
    return paid.union(supplied).union(person).union(firm)


ALL_RELATIONS_SQL = """
  SELECT o_orderkey * 10 AS rid, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'TRANSFERRED_MONEY' AS type,
    CASE o_orderkey % 5 WHEN 4 THEN 'REJECTED' WHEN 3 THEN 'INFERRED' ELSE 'OBSERVED' END AS status,
    (50 + o_orderkey * 7 % 50) / 100.0::DOUBLE AS confidence, o_orderdate AS seen_at, o_totalprice AS amount FROM orders
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'o' || l_orderkey, 's' || l_suppkey, 'ASSOCIATED_WITH',
    CASE l_linenumber % 5 WHEN 4 THEN 'REJECTED' WHEN 3 THEN 'INFERRED' ELSE 'OBSERVED' END,
    (50 + (l_orderkey * 7 + l_linenumber * 13) % 50) / 100.0::DOUBLE, l_shipdate, l_extendedprice FROM lineitem
  UNION ALL SELECT -(c_custkey * 2), 'c' || c_custkey, 'n' || c_nationkey, 'RESIDES_AT', 'OBSERVED', 0.9::DOUBLE, NULL, NULL FROM customer
  UNION ALL SELECT -(s_suppkey * 2 + 1), 's' || s_suppkey, 'n' || s_nationkey, 'RESIDES_AT', 'OBSERVED', 0.9::DOUBLE, NULL, NULL FROM supplier
"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Like all_relations, but a sparse graph for pairs, paths, centralities and communities: a customer's large returned parts.

    Customers and suppliers share so many orders that nearly every pair of them would be a link's candidate.
    """
    line = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    m = F.col("l_linenumber") % 5
    bought = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"),
        uid("c", "o_custkey").alias("src"),
        uid("p", "l_partkey").alias("dst"),
        F.when(F.col("l_linenumber") % 2 == 0, "OWNED").otherwise("TRANSFERRED_MONEY").alias("type"),
        F.when(m == 4, "REJECTED").when(m == 3, "INFERRED").otherwise("OBSERVED").alias("status"),
        ((50 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 50) / 100).alias("confidence"),
        F.col("o_orderdate").alias("seen_at"),
        F.col("l_extendedprice").alias("amount"),
    )
    return bought


RELATIONS_SQL = """
  SELECT l_orderkey * 10 + l_linenumber AS rid, 'c' || o_custkey AS src, 'p' || l_partkey AS dst,
    CASE WHEN l_linenumber % 2 = 0 THEN 'OWNED' ELSE 'TRANSFERRED_MONEY' END AS type,
    CASE l_linenumber % 5 WHEN 4 THEN 'REJECTED' WHEN 3 THEN 'INFERRED' ELSE 'OBSERVED' END AS status,
    (50 + (l_orderkey * 7 + l_linenumber * 13) % 50) / 100.0::DOUBLE AS confidence,
    o_orderdate AS seen_at, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45
"""


def priority_of(value: Column) -> Column:
    out = F.lit("LOW")
    for name, least in reversed(PRIORITIES):
        out = F.when(value >= least, name).otherwise(out)
    return out


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """(incident_id, type, subject, device, priority, seen_at, hour, lat, lng, zone_id): an event each, some without a place."""
    e = F.col("event_id")
    placed = e % 50 != 0
    return table(spark, d, "events").select(
        e.alias("incident_id"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("subject"),
        F.get_json_object("props", "$.k").cast("long").alias("device"),
        priority_of(F.col("value")).alias("priority"),
        F.col("ts").alias("seen_at"),
        F.hour("ts").alias("hour"),
        F.when(placed, 28.40 + (e * 7919 % 1000) * 0.00035).alias("lat"),
        F.when(placed, 76.95 + (e * 104729 % 1000) * 0.0005).alias("lng"),
        (e % 25).cast("int").alias("zone_id"),
    )


INCIDENTS_SQL = """
  SELECT event_id AS incident_id, event_type AS type, user_id AS subject,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS device,
    CASE WHEN value >= 200 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    ts AS seen_at, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
    CASE WHEN event_id % 50 <> 0 THEN 28.40::DOUBLE + (event_id * 7919 % 1000) * 0.00035::DOUBLE END AS lat,
    CASE WHEN event_id % 50 <> 0 THEN 76.95::DOUBLE + (event_id * 104729 % 1000) * 0.0005::DOUBLE END AS lng,
    CAST(event_id % 25 AS INTEGER) AS zone_id
  FROM events
"""


def zones(spark: SparkSession, d: str) -> DataFrame:
    """(zone_id, zone, zlat, zlng, radius): nations on a grid of five by five."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("zone_id"),
        F.col("n_name").alias("zone"),
        (28.435 + F.floor(k / 5) * 0.07).alias("zlat"),
        (77.0 + (k % 5) * 0.1).alias("zlng"),
        (2.0 + (k % 3) * 0.5).alias("radius"),
    )


ZONES_SQL = """
  SELECT n_nationkey AS zone_id, n_name AS zone, 28.435::DOUBLE + floor(n_nationkey / 5) * 0.07::DOUBLE AS zlat,
    77.0::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS zlng, 2.0::DOUBLE + (n_nationkey % 3) * 0.5::DOUBLE AS radius
  FROM nation
"""


def services(spark: SparkSession, d: str) -> DataFrame:
    """(service_id, slat, slng): suppliers over the same area."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("service_id"), (28.40 + (k * 7919 % 1000) * 0.00035).alias("slat"), (76.95 + (k * 104729 % 1000) * 0.0005).alias("slng"))


SERVICES_SQL = """
  SELECT s_suppkey AS service_id, 28.40::DOUBLE + (s_suppkey * 7919 % 1000) * 0.00035::DOUBLE AS slat,
    76.95::DOUBLE + (s_suppkey * 104729 % 1000) * 0.0005::DOUBLE AS slng FROM supplier
"""


#: Names for people and firms in rendered sentences.
FIRST_NAMES, LAST_NAMES, FIRMS = ("Asha", "Mohan", "Rahul", "Anita", "Vikram", "Meera", "Sunil"), ("Sharma", "Verma", "Gupta", "Nair", "Rao"), ("Shivam", "Orient", "Ganga", "Metro")


def _name(k: Column) -> Column:
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    return F.concat_ws(" ", pick(FIRST_NAMES, k), pick(LAST_NAMES, F.floor(k / len(FIRST_NAMES))))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    """(id, person, other, amount, firm, text): a paragraph an order; what each states is known by its kind, id modulo 4.

    The supplied texts state no relations that rules find, so these are rendered from the rows of orders.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        k.alias("id"), _name(c).alias("person"), _name(c + k % 34 + 1).alias("other"), F.floor("o_totalprice").cast("string").alias("amount"),
        F.concat(F.element_at(F.array(*map(F.lit, FIRMS)), (k % len(FIRMS) + 1).cast("int")), F.lit(" Traders")).alias("firm"),
    )
    who = F.concat(F.lit("Mr "), "person")
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.concat(who, F.lit(" transferred Rs "), "amount", F.lit(" to "), "firm", F.lit(".")))
    text = text.when(kind == 1, F.concat(who, F.lit(" met Ms "), "other", F.lit(" near the gate.")))
    text = text.when(kind == 2, F.concat(F.lit("It rained. "), who, F.lit(" called 98"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(" twice.")))
    return rows.withColumn("text", text.otherwise(F.concat(F.lit("Nothing more is known of Mr "), "person", F.lit("."))))


def _name_sql(k: str) -> str:
    return f"{list(FIRST_NAMES)}[({k}) % {len(FIRST_NAMES)} + 1] || ' ' || {list(LAST_NAMES)}[(({k}) // {len(FIRST_NAMES)}) % {len(LAST_NAMES)} + 1]"


def _sure_sql(gap: str, x: float, y: float) -> str:
    return f"round(least(0.95, 0.55 + 0.35 * greatest(0.4, 1 - ({gap}) / 220.0::DOUBLE)) * ({x} + {y}) / 2, 3)::DOUBLE"


NARRATIVE_ROWS_SQL = f"""
  SELECT o_orderkey AS id, {_name_sql("o_custkey")} AS person, {_name_sql("o_custkey + o_orderkey % 34 + 1")} AS other, floor(o_totalprice)::BIGINT::VARCHAR AS amount,
    {list(FIRMS)}[o_orderkey % {len(FIRMS)} + 1] || ' Traders' AS firm FROM orders
"""
NARRATIVE_TEXT_SQL = """CASE id % 4 WHEN 0 THEN 'Mr ' || person || ' transferred Rs ' || amount || ' to ' || firm || '.' WHEN 1 THEN 'Mr ' || person || ' met Ms ' || other || ' near the gate.'
  WHEN 2 THEN 'It rained. Mr ' || person || ' called 98' || lpad(id::VARCHAR, 8, '0') || ' twice.' ELSE 'Nothing more is known of Mr ' || person || '.' END"""
#: What the paragraphs state: (id, source, type, target, confidence, trigger_start).
NARRATIVE_FACTS_SQL = f"""
  WITH row AS ({NARRATIVE_ROWS_SQL})
  SELECT id, person AS source, 'TRANSFERRED_MONEY' AS type, 'Rs ' || amount AS target, {_sure_sql("13", 0.94, 0.94)} AS confidence, length(person) + 4 AS trigger_start FROM row WHERE id % 4 = 0
  UNION ALL SELECT id, person, 'TRANSFERRED_MONEY', firm, round({_sure_sql("13", 0.94, 0.94)} * 0.97, 3), length(person) + 4 FROM row WHERE id % 4 = 0
  UNION ALL SELECT id, person, 'MET', other, {_sure_sql("8", 0.94, 0.94)}, length(person) + 4 FROM row WHERE id % 4 = 1
  UNION ALL SELECT id, person, 'CALLED', '98' || lpad(id::VARCHAR, 8, '0'), {_sure_sql("8", 0.94, 0.96)}, length(person) + 15 FROM row WHERE id % 4 = 2
"""


def persons(spark: SparkSession, d: str) -> DataFrame:
    """(uid, name, aliases, attributes, cases): customers as persons; every fifth by an initial, four an address, a birthday in 200."""
    k = F.col("c_custkey")
    full = _name(k)
    name = F.when(k % 5 == 3, F.concat(F.substring(full, 1, 1), F.lit(". "), F.element_at(F.split(full, " "), 2))).otherwise(full)
    attributes = F.create_map(F.lit("address"), F.concat(F.lit("House "), F.floor(k / 4).cast("string")), F.lit("dob"), F.concat(F.lit("d"), (k % 200).cast("string")))
    return table(spark, d, "customer").select(uid("c", "c_custkey").alias("uid"), name.alias("name"), F.array().cast("array<string>").alias("aliases"), attributes.alias("attributes"), F.array("c_mktsegment").alias("cases"))


def person_edges(spark: SparkSession, d: str) -> DataFrame:
    """(uid, neighbour, at): the parts of every order's lines, places, and phones, which two of four customers share."""
    k = F.col("c_custkey")
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = line.groupBy(uid("c", "o_custkey").alias("uid"), uid("p", "l_partkey").alias("neighbour")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    own = table(spark, d, "customer")
    phones = own.where(k % 4 < 2).select(uid("c", "c_custkey"), F.concat(F.lit("f"), F.floor(k / 4).cast("string")), F.lit(0).cast("long"))
    return parts.union(phones).union(own.select(uid("c", "c_custkey"), uid("n", "c_nationkey"), F.lit(0).cast("long")))


def held(spark: SparkSession, d: str) -> DataFrame:
    """(neighbour, kind, value): vehicles with their plates, and phones."""
    k = F.col("c_custkey")
    vehicles = table(spark, d, "part").select(uid("p", "p_partkey").alias("neighbour"), F.lit("vehicle").alias("kind"), F.concat(F.lit("DL-"), F.col("p_partkey").cast("string")).alias("value"))
    j = F.floor(k / 4).cast("string")
    return vehicles.union(table(spark, d, "customer").where(k % 4 == 0).select(F.concat(F.lit("f"), j), F.lit("phone"), F.concat(F.lit("98"), F.lpad(j, 8, "0"))))


PERSON_EDGES_SQL = """
  SELECT 'c' || o_custkey AS uid, 'p' || l_partkey AS neighbour, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL SELECT 'c' || c_custkey, 'f' || c_custkey // 4, 0 FROM customer WHERE c_custkey % 4 < 2
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0 FROM customer
"""
PERSONS_SQL = f"""
  WITH e AS ({PERSON_EDGES_SQL}), v AS (SELECT uid, arg_min(neighbour[2:], (seq, neighbour)) AS p FROM e WHERE neighbour[1] = 'p' GROUP BY uid), called AS (SELECT *, {_name_sql("c_custkey")} AS whole FROM customer)
  SELECT 'c' || c_custkey AS uid, CASE WHEN c_custkey % 5 = 3 THEN whole[1] || '. ' || split_part(whole, ' ', 2) ELSE whole END AS name, 'House ' || c_custkey // 4 AS address, 'd' || c_custkey % 200 AS dob,
    CASE WHEN c_custkey % 4 < 2 THEN '98' || lpad((c_custkey // 4)::VARCHAR, 8, '0') END AS phone, 'DL' || p AS vehicle, c_mktsegment AS case_id
  FROM called LEFT JOIN v ON v.uid = 'c' || c_custkey
"""
