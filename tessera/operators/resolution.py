"""Entity resolution: blocking keys, candidate pairs, six factors, floors and caps. Nothing merges by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.components import components
from tessera.storage import stored

# fixed values: weights of the factors; strength of an identifier; those that only one person has
WEIGHTS = {"name": 0.26, "abbreviation": 0.14, "phonetic": 0.05, "identifiers": 0.33, "neighbours": 0.14, "cases": 0.08}
IDENTIFIERS = {"id_proof": 0.80, "device_id": 0.78, "vehicle": 0.75, "phone": 0.72, "email": 0.65, "address": 0.45, "dob": 0.35}
EXCLUSIVE = ("id_proof", "device_id")
BLOCKED = ("phone", "vehicle", "id_proof", "email", "device_id")
STRONG, LIKE_NAMES = 0.65, 0.72
LARGEST_BLOCK, LARGEST_QUEUE, THRESHOLD = 60, 60, 0.55


def _name_keys() -> Column:
    """Blocking keys of the columns type, name and aliases; some are null."""
    none = F.array().cast("array<string>")

    def named(surface: Column) -> Column:
        clean = F.trim(F.regexp_replace(surface, r"[^A-Za-z0-9\s]", ""))
        parts = T.words(clean)
        last = F.try_element_at(parts, F.lit(-1))
        person = F.array(F.concat(F.lit("snd:"), T.sound(last)), F.concat(F.lit("ini:"), F.upper(F.substring(F.get(parts, F.lit(0)), 1, 1)), F.upper(F.substring(last, 1, 1))))
        other = F.array(F.concat(F.lit("pre:"), F.lower(F.substring(clean, 1, 4))), F.concat(F.lit("len:"), F.length(clean).cast("string")))
        return F.when(clean == "", none).otherwise(F.when(F.col("type") == "person", person).otherwise(other))

    return F.flatten(F.transform(F.concat(F.array("name"), F.coalesce("aliases", none)), named))


def blocking_keys(records: DataFrame) -> DataFrame:
    """Records (uid, type, name, aliases, attributes, ...) to distinct (uid, type, key)."""
    attr = F.array(*(F.when(F.coalesce(F.col("attributes")[k], F.lit("")) != "", F.concat(F.lit(f"attr:{k}:"), F.lower(F.trim(F.col("attributes")[k])))) for k in BLOCKED))
    keys = F.array_distinct(F.filter(F.concat(_name_keys(), attr), lambda k: k.isNotNull()))
    return records.select("uid", "type", F.explode(keys).alias("key"))


def candidate_pairs(records: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """(a, b) for a < b of one type that share a key of 2 to `largest` records; larger blocks say nothing about a pair."""
    keys = blocking_keys(records)
    small = keys.groupBy("type", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, largest)).select("type", "key")
    kept = keys.join(small, ["type", "key"], "left_semi")
    a, b = kept.select("type", "key", F.col("uid").alias("a")), kept.select("type", "key", F.col("uid").alias("b"))
    return a.join(b, ["type", "key"]).where("a < b").select("a", "b").distinct()


def person_records(persons: DataFrame, edges: DataFrame, held: DataFrame) -> DataFrame:
    """Persons (uid, name, aliases, attributes, cases) as records, with the first phone and vehicle that each is linked to.

    edges: (uid, neighbour, at); held: (neighbour, kind, value) of phones and vehicles. The smallest (at, neighbour) comes
    first; an attribute that a person has of its own stays; a vehicle's value loses blanks and dashes.
    """
    first = edges.join(held, "neighbour").groupBy("uid", "kind").agg(F.min_by("value", F.struct("at", "neighbour")).alias("value"))
    value = F.when(F.col("kind") == "vehicle", F.regexp_replace("value", "[ -]", "")).otherwise(F.col("value"))
    one = first.groupBy("uid").agg(*(F.max(F.when(F.col("kind") == k, value)).alias(f"_{k}") for k in ("phone", "vehicle")))
    out = persons.join(one, "uid", "left").withColumn("type", F.lit("person"))
    has = lambda k: F.coalesce(F.map_contains_key("attributes", k), F.lit(False))
    pairs = [F.when(F.col(f"_{k}").isNotNull() & ~has(k), F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value"))) for k in ("phone", "vehicle")]
    more = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.isNotNull()))
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    return out.select("uid", "type", "name", "aliases", F.map_concat(own, more).alias("attributes"), "cases")


def _ends(surface: Column) -> Column:
    """The last part of a name as abbreviations see it."""
    return F.try_element_at(F.filter(F.split(F.lower(F.regexp_replace(surface, r"\.", " ")), r"\s+"), lambda w: w != ""), F.lit(-1))


def neighbours_of(records: DataFrame) -> DataFrame:
    """(uid, neighbour) of records that list their neighbours."""
    return records.select("uid", F.explode("neighbours").alias("neighbour")).distinct()


def _marked(edges: DataFrame) -> DataFrame:
    """Edges (uid, neighbour, hub): hub marks the most common neighbour of each record, in an order that all records share."""
    common = edges.groupBy("neighbour").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), F.desc("neighbour")))
    return edges.select("uid", "neighbour").join(common, "neighbour").select("uid", "neighbour", (place == 1).alias("hub"))


def _initials(surfaces: Column) -> Column:
    """Structs (k, short) of names: one that can stand for another has a k with short that the other has without.

    k are the initials of a name's last parts, and whether parts lie before them. A name stands for another whose last
    parts have its initials; if none of its own parts is an initial, the other must have more parts.
    """
    none = F.array().cast("array<struct<k:string,short:boolean>>")
    key = lambda heads, end, short: F.struct(F.concat(F.array_join(heads, ""), F.lit(end) if isinstance(end, str) else end).alias("k"), F.lit(short).alias("short"))

    def keys(surface: Column) -> Column:
        parts = F.reverse(F.filter(F.split(F.lower(F.regexp_replace(surface, r"\.", " ")), r"\s+"), lambda w: w != ""))
        heads, n = F.transform(parts, lambda w: F.substring(w, 1, 1)), F.size(parts)
        short = F.array(key(heads, "<", True), F.when(F.exists(parts, lambda w: F.length(w) == 1), key(heads, "=", True)))
        full = F.transform(F.sequence(F.lit(1), n), lambda m: key(F.slice(heads, F.lit(1), m), F.when(m < n, "<").otherwise("="), False))
        return F.when(n > 0, F.concat(short, full)).otherwise(none)

    return F.array_distinct(F.filter(F.flatten(F.transform(surfaces, lambda s: F.coalesce(keys(s), none))), lambda x: x.isNotNull()))


def _names(records: DataFrame) -> DataFrame:
    """(cls, type, name, aliases, blocks, shorts, fulls): different names, their blocking keys, and those keys of _initials() that some name has with short and some without."""
    rows = records.select("type", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).distinct()
    rows = stored(rows.withColumn("cls", F.md5(F.to_json(F.struct("type", "name", "aliases")))), "names")
    key = F.xxhash64("type", "i.k").alias("k")
    keys = rows.select("cls", "type", F.explode(_initials(F.concat(F.array("name"), "aliases"))).alias("i")).select("cls", key, F.col("i.short").alias("short"))
    useful = keys.groupBy("k").agg(F.max("short").alias("some"), F.min("short").alias("every")).where("some and not every").select("k")
    keys = keys.join(useful, "k", "left_semi").groupBy("cls").agg(F.collect_set(F.when(F.col("short"), F.col("k"))).alias("shorts"), F.collect_set(F.when(~F.col("short"), F.col("k"))).alias("fulls"))
    none = F.array().cast("array<bigint>")
    blocks = F.filter(_name_keys(), lambda k: k.isNotNull())
    return stored(rows.withColumn("blocks", blocks).join(keys, "cls", "left").withColumns({c: F.coalesce(c, none) for c in ("shorts", "fulls")}), "names")


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(ca, cb, short, phonetic, name, block) of different pairs (ca, cb) of names, each compared once."""
    last = lambda r: F.coalesce(T.sound(F.try_element_at(T.words(F.col(f"{r}.name")), F.lit(-1))), F.lit(""))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, costly comparisons: not to be merged into few tasks
    both = pairs.select("ca", "cb").distinct().join(names.alias("ra"), F.col("ca") == F.col("ra.cls")).join(names.alias("rb"), F.col("cb") == F.col("rb.cls")).where("ra.type = rb.type")
    both = both.select("ca", "cb", *(F.struct(*(F.col(f"{x}.{c}") for c in ("name", "aliases", "blocks"))).alias(x) for x in ("ra", "rb"))).repartition(parts, "ca", "cb")
    name = F.array_max(_pairwise(_surfaces("ra"), _surfaces("rb"), lambda x, y: F.greatest(T.jaro_winkler(x, y), T.edit_ratio(x, y))))
    short = F.coalesce(_short(), F.lit(False)).alias("short")
    return stored(both.select("ca", "cb", short, ((last("ra") != "") & (last("ra") == last("rb"))).alias("phonetic"), name.alias("name"), F.arrays_overlap("ra.blocks", "rb.blocks").alias("block")), "named")


def _compared(x: str, y: str, *more: Column) -> Column:
    """Two records (structs), the smaller uid as a, and what they have in common but for their names: bits of identifiers, cases, and whether their hubs are one.

    Rows are made by a generator, below which no filter moves: it would work all this out again for each use.
    """
    empty = F.array().cast("array<string>")
    bits = sum((F.when(F.col(f"{x}.{k}") == F.col(f"{y}.{k}"), 1 << i).otherwise(0) for i, k in enumerate(IDENTIFIERS)), F.lit(0))
    cases = F.size(F.array_intersect(F.coalesce(f"{x}.cases", empty), F.coalesce(f"{y}.cases", empty)))
    one = F.coalesce(F.col(f"{x}.hub") == F.col(f"{y}.hub"), F.lit(False)).cast("int")
    first = F.col(f"{x}.uid") < F.col(f"{y}.uid")
    pair = lambda c: (F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")), F.when(first, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")))
    (a, b), (ca, cb) = pair("uid"), pair("cls")
    row = F.struct(a.alias("a"), b.alias("b"), ca.alias("ca"), cb.alias("cb"), bits.alias("bits"), cases.alias("cases"), one.cast("long").alias("one"), *more)
    return F.inline(F.array(row))


def _shared(bits: Column) -> Column:
    """The identifiers of bits."""
    hit = [F.when(bits.bitwiseAND(1 << i) != 0, F.struct(F.lit(s).alias("strength"), F.lit(k).alias("identifier"))) for i, (k, s) in enumerate(IDENTIFIERS.items())]
    return F.filter(F.array(*hit), lambda h: h.isNotNull())


STRONG_BITS = sum(1 << i for i, s in enumerate(IDENTIFIERS.values()) if s >= STRONG)
BLOCKED_BITS = sum(1 << i for i, k in enumerate(IDENTIFIERS) if k in BLOCKED)


def _reachable(name: Column, short: Column, phonetic: Column) -> Column:
    """Whether a pair's score may be THRESHOLD: it has a strong identifier, or its factors, not rounded, add up to that."""
    hits = [F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(s)).otherwise(0.0) for i, s in enumerate(IDENTIFIERS.values())]
    ids = F.when(F.col("bits") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(*hits) + 0.06 * (F.bit_count("bits") - 1)))
    values = {"name": F.coalesce(name, F.lit(0.0)), "abbreviation": short.cast("double"), "phonetic": phonetic.cast("double"), "identifiers": ids, "neighbours": F.least(F.lit(1.0), F.col("neighbours") / 3), "cases": F.least(F.lit(1.0), F.col("cases") / 2)}
    return (F.col("bits").bitwiseAND(STRONG_BITS) != 0) | (sum((w * values[k] for k, w in WEIGHTS.items()), F.lit(0.0)) >= THRESHOLD - 0.001)


#: Pairs of names up to which they are broadcast to those who compare records.
FEW_NAMES = 100_000


def evidence(records: DataFrame, edges: DataFrame | None = None, alike: bool = True) -> DataFrame:
    """(a, b, short, phonetic, name, bits, cases, neighbours) for a < b of one type that share a blocking key, of a block of any size, and can reach THRESHOLD.

    alike: by how alike names are; else as if all were equal.

    By the weights a pair without an identifier reaches it only with a common neighbour and an abbreviation (without
    one 0.53 at most). One with a single weak identifier (address, dob) needs one of them (0.5385 at most). So each
    such pair agrees in one of these: a strong identifier; both weak ones; a weak one and a neighbour; a weak one
    or a neighbour, and initials by which names can stand for each other (_initials()). With at most one common case,
    one common neighbour isn't enough (0.5367 with an abbreviation, 0.5452 with a weak identifier).

    So records meet at their neighbours but for each one's hub, its most common one. Where hubs differ, the less common
    of them may be among the other's neighbours, so a hub meets those that have it besides; where they are one, that is
    a common neighbour more. Of pairs that meet so, common neighbours are counted where they meet; all others with an
    identifier and an abbreviation have none but the hub, and are told from their records alone. Keys are hashes; what a
    collision adds, the score drops. Different names are compared once.
    """
    edges = neighbours_of(records) if edges is None else edges
    names = _names(records)
    value = lambda k: F.nullif(F.lower(F.trim(F.col("attributes")[k])), F.lit(""))
    weak = [k for k, s in IDENTIFIERS.items() if s < STRONG]
    tag = lambda *parts: F.xxhash64("type", *parts)
    filled = lambda *of: F.lit(True) if not of else F.col(of[0]).isNotNull() & filled(*of[1:])
    cls = F.md5(F.to_json(F.struct("type", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))))
    r = records.select("uid", "type", "name", "aliases", cls.alias("cls"), "cases", *(value(k).alias(k) for k in IDENTIFIERS))
    r = r.withColumn("weak", F.filter(F.array(*(F.when(filled(k), F.struct(F.lit(k).alias("kind"), tag(F.lit(k), F.col(k)).alias("w"))) for k in weak)), lambda x: x.isNotNull()))
    r = r.join(names.select("cls", "shorts", "fulls").hint("merge"), "cls")
    near = _marked(edges).join(r.select("uid", "weak", "shorts", "fulls").hint("merge"), "uid")
    near = stored(near.select("uid", F.xxhash64("neighbour").alias("n"), "hub", F.transform("weak", lambda x: x["w"]).alias("weak"), "shorts", "fulls"), "near")
    r = stored(r.join(near.where("hub").select("uid", F.col("n").alias("hub")).hint("merge"), "uid", "left"), "resolved")

    def ordered(x: DataFrame, y: DataFrame, on: list[str], where: str) -> DataFrame:
        met = x.hint("merge").join(y.withColumnsRenamed({"uid": "other", "hub": "other_hub"}), on).where(where)
        return met.withColumns({"a": F.least("uid", "other"), "b": F.greatest("uid", "other")})

    by_weak = near.select("uid", "n", "hub", F.explode("weak").alias("w"))
    counted = ordered(by_weak.where("not hub"), by_weak, ["w", "n"], "other_hub or uid < other").groupBy("a", "b", "w").agg(F.count("*").alias("n")).select("a", "b", "n")
    # shorts meet fulls of which one at least isn't at its hub: all shorts those that aren't (x), those that aren't the others (y)
    shorts = near.select("uid", "n", F.explode(F.when(F.col("hub"), F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))).alias("side"), "shorts")
    shorts = shorts.select("uid", F.col("n"), "side", F.explode("shorts").alias("k"))
    fulls = near.select("uid", "n", F.when(F.col("hub"), "y").otherwise("x").alias("side"), F.explode("fulls").alias("k"))
    by_name = ordered(shorts.withColumn("hub", F.lit(False)), fulls, ["n", "k", "side"], "uid <> other").groupBy("a", "b").agg(F.size(F.collect_set("n")).cast("long").alias("n"))
    counted = stored(counted.union(by_name).groupBy("a", "b").agg(F.max("n").alias("n")), "counted")

    # strong identifiers, and all weak ones together
    whole = [F.when(filled(k), tag(F.lit(k), F.col(k))) for k in IDENTIFIERS if k not in weak] + [F.when(filled(*weak), tag(F.lit("weak"), *map(F.col, weak)))]
    plain = stored(r.select("uid", F.explode(F.array(*whole)).alias("key")).where("key is not null"), "evidence")
    sure = plain.withColumnRenamed("uid", "a").hint("merge").join(plain.withColumnRenamed("uid", "b"), "key").where("a < b").select("a", "b").distinct()
    sure = stored(sure, "sure")
    sure = sure.join(common_neighbours(sure, edges), ["a", "b"], "left").select("a", "b", F.coalesce("n_common", F.lit(0)).cast("long").alias("all"))
    rows = counted.select("a", "b", "n", F.lit(None).cast("long").alias("all")).union(sure.select("a", "b", F.lit(0).cast("long"), "all"))
    many = r.where(F.size(F.array_distinct(F.coalesce("cases", F.array().cast("array<string>")))) > 1)
    if not many.isEmpty():
        # with two common cases a hub is enough
        own = ordered(many.select("uid", F.col("hub").alias("at"), F.explode("shorts").alias("k")), many.select("uid", F.col("hub").alias("at"), F.explode("fulls").alias("k")), ["at", "k"], "uid <> other")
        rows = rows.union(own.select("a", "b", F.lit(0).cast("long"), F.lit(None).cast("long")))
    fields = ("uid", "type", "cls", *IDENTIFIERS, "cases", "hub")
    one = lambda c: r.select(F.col("uid").alias(c), F.struct(*fields).alias(f"r{c}")).hint("merge")
    rows = rows.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("all").alias("all")).join(one("a"), "a").join(one("b"), "b").where("ra.type = rb.type")
    rows = rows.select(_compared("ra", "rb", F.col("n"), F.col("all"))).withColumn("neighbours", F.coalesce("all", F.col("n") + F.col("one"))).drop("n", "all", "one")
    rows = stored(rows.where(_reachable(F.lit(1.0), F.lit(True), F.lit(True))), "met")

    # a weak identifier and an abbreviation: where names and it aren't enough, a case or the hub is common too
    cut = r.select("cls", "shorts", "fulls", F.explode("weak.w").alias("w"))
    meet = cut.select("cls", "w", F.explode("shorts").alias("k")).distinct().join(cut.select(F.col("cls").alias("other"), "w", F.explode("fulls").alias("k")).distinct(), ["w", "k"]).select("cls", "other").distinct()
    meet = stored(meet, "meet")
    named = _named(rows.select("ca", "cb").union(meet).union(meet.select("other", "cls")), names)
    name = F.col("name") if alike else F.lit(1.0)
    alone = {"cases": F.lit(0), "neighbours": F.lit(0)}
    enough = [named.withColumns({"bits": F.lit(1 << list(IDENTIFIERS).index(k)), "kind": F.lit(k), **alone}).where(_reachable(name, F.col("short"), F.col("phonetic"))).select("kind", F.explode(F.array("ca", "cb")).alias("cls")) for k in weak]
    free = reduce(DataFrame.union, enough).groupBy("cls").agg(F.collect_set("kind").alias("free"))
    few = named.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    looked = F.broadcast(named) if few else named.hint("merge")  # behind a count
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, many pairs: not to be merged into few tasks
    too = F.array_append(F.transform(F.array_distinct(F.coalesce("cases", F.array().cast("array<string>"))), lambda c: F.xxhash64(F.lit("case"), c)), F.when(F.col("hub").isNotNull(), F.xxhash64(F.lit("hub"), "hub")))
    too = F.array_append(too, F.when(F.array_contains("free", F.col("v.kind")), F.lit(0).cast("long")))
    own = r.join(free.hint("merge"), "cls", "left").select(F.struct(*fields).alias("r"), "shorts", "fulls", "free", "cases", "hub", F.explode("weak").alias("v"))
    own = own.select("r", "shorts", "fulls", F.col("v.w").alias("w"), F.explode(too).alias("too")).where("too is not null")
    x = own.select(F.col("r").alias("x"), "w", "too", F.explode("shorts").alias("k")).repartition(parts, "w", "k", "too")
    y = own.select(F.col("r").alias("y"), "w", "too", F.explode("fulls").alias("k")).repartition(parts, "w", "k", "too")
    met = x.hint("merge").join(y, ["w", "k", "too"]).where("x.uid <> y.uid and x.type = y.type").select(_compared("x", "y")).withColumnRenamed("one", "neighbours")
    likely = [f.select("a", "b", "ca", "cb", "bits", "cases", "neighbours").join(looked, ["ca", "cb"]).where(_reachable(name, F.col("short"), F.col("phonetic"))) for f in (rows, met)]
    out = likely[0].union(likely[1]).where(F.col("block") | (F.col("bits").bitwiseAND(BLOCKED_BITS) != 0))
    same = [F.first(c).alias(c) for c in ("short", "phonetic", "name", "bits", "cases")]
    return out.groupBy("a", "b").agg(*same, F.max("neighbours").cast("int").alias("neighbours"))


def exact_pairs(records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(a, b) of evidence(), whatever their names."""
    return evidence(records, edges, alike=False).select("a", "b")


#: Records of a key from which its different names meet before its records do.
MANY = 256


def _abbreviated(rows: DataFrame, many: int = MANY) -> DataFrame:
    """(a, b) for a < b of rows (uid, name, aliases, key, role) of one key, of role 0 both or one of 1 and one of 2, whose names can stand for each other.

    By comparing them: what evidence() finds by initials is tested against this.
    """
    rows = stored(rows, "ended")
    large = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("key"), "large")
    roles = "(ra.role = 0 and rb.role = 0) or ra.role + rb.role = 3"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, costly comparisons: not to be merged into few tasks
    small = rows.join(large, "key", "left_anti").repartition(parts, "key")
    direct = small.alias("ra").join(small.alias("rb"), F.col("ra.key") == F.col("rb.key")).where("ra.uid < rb.uid").where(roles).where(_short()).select(F.col("ra.uid").alias("a"), F.col("rb.uid").alias("b"))
    crowd = rows.join(large, "key", "left_semi")
    named = stored(crowd.select("key", "role", "name", "aliases").distinct(), "names")
    meet = named.alias("ra").join(named.alias("rb"), F.col("ra.key") == F.col("rb.key")).where(roles).where(_short())
    meet = meet.select(F.col("ra.key").alias("key"), *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in ("ra", "rb") for c in ("role", "name", "aliases")))
    one = lambda x, end: crowd.select("key", F.col("uid").alias(end), *(F.col(c).alias(f"{c}_{x}") for c in ("role", "name", "aliases")))
    on = lambda x: ["key", f"role_{x}", f"name_{x}", f"aliases_{x}"]
    return direct.union(meet.join(one("ra", "a"), on("ra")).join(one("rb", "b"), on("rb")).where("a < b").select("a", "b"))


def common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n_common): how many neighbours a pair shares; pairs that share none are absent. No neighbour set is gathered."""
    a, b = edges.select(F.col("uid").alias("a"), "neighbour"), edges.select(F.col("uid").alias("b"), "neighbour")
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "neighbour"]).groupBy("a", "b").agg(F.count("*").alias("n_common"))


def _surfaces(alias: str) -> Column:
    return F.array_distinct(F.transform(F.concat(F.array(F.col(f"{alias}.name")), F.coalesce(F.col(f"{alias}.aliases"), F.array().cast("array<string>"))), lambda s: F.lower(s)))


def _pairwise(a: Column, b: Column, f) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def _short() -> Column:
    """Whether a surface of ra can stand for one of rb, or the other way round."""
    return F.exists(_pairwise(_surfaces("ra"), _surfaces("rb"), lambda x, y: T.is_abbreviation(x, y) | T.is_abbreviation(y, x)), lambda v: v)


def score_pairs(records: DataFrame, pairs: DataFrame, edges: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(a, b, score, factors) of pairs; records also have aliases and cases (arrays), and neighbours unless edges
    (uid, neighbour; distinct rows) are given.

    least: only pairs of that score; names, which cost most, are compared where equal ones would reach it.
    """
    edges = neighbours_of(records) if edges is None else edges
    j = pairs.join(common_neighbours(pairs, edges), ["a", "b"], "left").join(records.alias("ra"), F.col("a") == F.col("ra.uid")).join(records.alias("rb"), F.col("b") == F.col("rb.uid"))
    sa, sb = _surfaces("ra"), _surfaces("rb")
    last = lambda r: F.coalesce(T.sound(F.try_element_at(T.words(F.col(f"{r}.name")), F.lit(-1))), F.lit(""))
    phonetic = (last("ra") != "") & (last("ra") == last("rb"))
    norm = lambda r, k: F.lower(F.trim(F.coalesce(F.col(f"{r}.attributes")[k], F.lit(""))))
    hit = [F.when((norm("ra", k) != "") & (norm("ra", k) == norm("rb", k)), F.struct(F.lit(s).alias("strength"), F.lit(k).alias("identifier"))) for k, s in IDENTIFIERS.items()]
    shared = F.filter(F.array(*hit), lambda h: h.isNotNull())
    empty = F.array().cast("array<string>")
    common = lambda c: F.size(F.array_intersect(F.coalesce(F.col(f"ra.{c}"), empty), F.coalesce(F.col(f"rb.{c}"), empty)))
    out = j.select("a", "b", sa.alias("sa"), sb.alias("sb"), _short().alias("short"), phonetic.alias("phonetic"), shared.alias("shared"), F.coalesce("n_common", F.lit(0)).cast("int").alias("neighbours"), common("cases").alias("cases"))
    if least is not None:  # stored: a filter that moves below a projection works out the costly columns once more for each use
        out = stored(out, "compared").where(_score(F.lit(1.0), _factors(F.lit(1.0))) >= least)
    name = F.array_max(_pairwise(F.col("sa"), F.col("sb"), lambda x, y: F.greatest(T.jaro_winkler(x, y), T.edit_ratio(x, y))))
    out = out.withColumn("name", name)
    out = _scored(out if least is None else stored(out, "named"))
    return out if least is None else out.where(F.col("score") >= least)


def _scored(compared: DataFrame) -> DataFrame:
    out = compared.withColumn("factors", _factors(F.col("name")))
    return out.select("a", "b", _score(F.col("name"), F.col("factors")).alias("score"), "factors")


def _factors(name: Column) -> Column:
    """The factors above 0 of a compared pair, whose names are alike by name."""
    n = F.size("shared")
    identifiers = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.array_max(F.transform("shared", lambda s: s["strength"])) + 0.06 * (n - 1)))
    values = {"name": name, "abbreviation": F.col("short").cast("double"), "phonetic": F.col("phonetic").cast("double"), "identifiers": identifiers, "neighbours": F.least(F.lit(1.0), F.col("neighbours") / 3), "cases": F.least(F.lit(1.0), F.col("cases") / 2)}
    factors = F.array(*(F.struct(F.round(F.lit(w) * values[k], 4).alias("contribution"), F.lit(k).alias("factor"), values[k].alias("value")) for k, w in WEIGHTS.items()))
    return F.sort_array(F.filter(factors, lambda f: f["value"] > 0), asc=False)


def _score(name: Column, factors: Column) -> Column:
    """The score of a compared pair: the sum of its factors, with floors and caps; it never falls when names are more alike."""
    n = F.size("shared")
    total = F.aggregate(factors, F.lit(0.0), lambda acc, f: acc + f["contribution"])
    strong = F.filter("shared", lambda s: s["strength"] >= STRONG)
    contacts = F.col("short") | (F.col("neighbours") > 0) | (F.col("cases") > 0)
    exclusive = F.exists(strong, lambda s: s["identifier"].isin(*EXCLUSIVE))
    applies = exclusive | (F.size(strong) > 1) | ((F.size(strong) == 1) & (contacts | (name >= LIKE_NAMES)))
    best = F.array_max(F.transform(strong, lambda s: s["strength"]))
    floor = F.when(F.size(strong) > 1, F.least(F.lit(0.92), best + 0.06 * (F.size(strong) - 1))).when(exclusive, best).otherwise(best * 0.82)
    raised = F.when(applies, F.greatest(total, floor)).otherwise(total)
    # without an identifier or common contacts, likeness of names alone stays below a confident match
    capped = F.when(~contacts & (n == 0), F.least(raised, F.lit(0.62))).otherwise(raised)
    return F.round(F.least(F.lit(0.99), capped), 4)


def proposals(records: DataFrame, decided: DataFrame | None = None, least: float = THRESHOLD, edges: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Scored candidates of at least the threshold that nobody has decided on.

    exact: also those whose common blocks are all larger than LARGEST_BLOCK; the least score can't be below THRESHOLD then.
    """
    if exact and least < THRESHOLD:
        raise ValueError(f"exact pairs reach {THRESHOLD} or more")
    gone = None if decided is None else decided.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_ = lambda pairs: pairs if gone is None else pairs.join(gone, ["a", "b"], "left_anti")
    if exact:
        out = open_(evidence(records, edges)).withColumn("shared", _shared(F.col("bits")))
        return _scored(stored(out, "likely")).where(F.col("score") >= least)
    return score_pairs(records, open_(stored(candidate_pairs(records), "pairs")), edges, least)  # scores read them twice


def refreshed(queue: DataFrame, found: DataFrame, limit: int = LARGEST_QUEUE) -> DataFrame:
    """A queue (a, b, status, score, factors) after a search: of the best found, pending pairs are rewritten, new ones added.

    Decided pairs stay as they are and aren't proposed again, but count among the best. Ties go by (a, b).
    """
    best = found.orderBy(F.desc("score"), "a", "b").limit(limit).select("a", "b", F.col("score").alias("new_score"), F.col("factors").alias("new_factors"))
    both = queue.join(best, ["a", "b"], "full")
    open_ = F.coalesce("status", F.lit("PENDING")) == "PENDING"
    pick = lambda c: F.when(open_, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c)
    return both.select("a", "b", F.coalesce("status", F.lit("PENDING")).alias("status"), pick("score"), pick("factors"))


def payload(queue: DataFrame, entities: DataFrame) -> DataFrame:
    """Queue rows with both names and aliases, factors by contribution, the score to three places, and whether a review is due."""
    one = lambda x: entities.select(F.col("uid").alias(x), F.col("name").alias(f"name_{x}"), F.col("aliases").alias(f"aliases_{x}"))
    rows = queue.withColumn("factors", F.sort_array("factors", asc=False))
    return rows.join(one("a"), "a").join(one("b"), "b").select("*", F.round("score", 3).alias("confidence"), (F.col("status") == "PENDING").alias("review_required"))


def page(queue: DataFrame, entities: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the queue, best first, with the count of all rows of that status and of each status."""
    chosen = queue if status is None else queue.where(F.col("status") == status.upper())
    counts = queue.groupBy("status").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda r: F.concat(r["status"], F.lit(":"), r["n"].cast("string"))), ",")
    rows = payload(chosen.orderBy(F.desc("score"), "a", "b").offset(offset).limit(limit), entities)
    one = chosen.agg(F.count("*").alias("total")).crossJoin(counts.agg(text.alias("status_counts")))  # frames of one row
    return rows.crossJoin(one)


def merged(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """Entities (uid, name, aliases, active, alias_of) after accepted pairs (a, b), also where pairs make chains.

    Of all that accepted pairs connect, the longest name survives (ties: the smallest uid); the others are inactive,
    point to it, and leave it their names and aliases.
    """
    known = entities.select("uid")
    pairs = accepted.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(known.withColumnRenamed("uid", "src"), "src", "left_semi").join(known.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    group = stored(components(pairs), "merged")
    own = entities.join(group, F.col("uid") == F.col("node"))
    names = F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    survivor = F.min(F.struct((-F.length("name")).alias("size"), "uid"))
    groups = own.groupBy("component").agg(names.alias("names"), survivor.alias("kept")).select("component", "names", F.col("kept.uid").alias("kept"))
    out = entities.join(group.join(groups, "component").select(F.col("node").alias("uid"), "names", "kept"), "uid", "left")
    alias_of = F.when(F.col("kept") != F.col("uid"), F.col("kept"))
    more = F.when(F.col("kept") == F.col("uid"), F.col("names")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), more))
    fresh = F.filter(every, lambda n: T.normal_name(n) != T.normal_name(F.col("name")))
    return out.select("uid", "name", F.array_sort(fresh).alias("aliases"), (F.col("active") & alias_of.isNull()).alias("active"), alias_of.alias("alias_of"))


def rewritten(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (src, dst, type, status) with absorbed ends given to their survivors of merged(), once and without loops, and alias_of edges."""
    gone = entities.where("alias_of is not null").select("uid", "alias_of")
    out = edges.select("src", "dst", "type", "status")
    for end in ("src", "dst"):
        out = out.join(gone.toDF(end, "survivor"), end, "left").withColumn(end, F.coalesce("survivor", end)).select("src", "dst", "type", "status")
    own = gone.select(F.col("alias_of").alias("src"), F.col("uid").alias("dst"), F.lit("alias_of").alias("type"), F.lit("VALIDATED").alias("status"))
    return out.where("src <> dst").dropDuplicates(["src", "dst", "type"]).unionByName(own)


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("place = 1").drop("place")
