"""Patterns across incidents: shared vehicles and devices, concentrations, common subjects, repeated encounters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered
from tessera.storage import stored


def shared(incidents: DataFrame, key: Column, kind: str, least: int, cap: float, base: float, step: float, per_place: float = 0.0) -> DataFrame:
    """Groups of at least `least` incidents with one key; confidence grows with the incidents and their places."""
    n, places = F.count("*"), F.count_distinct("zone_id")
    grouped = incidents.where(key.isNotNull()).groupBy(key.cast("string").alias("descriptor")).agg(n.alias("n"), places.alias("places"))
    confidence = F.least(F.lit(cap), base + step * F.col("n") + per_place * F.col("places"))
    return grouped.where(F.col("n") >= least).select(F.lit(kind).alias("kind"), "descriptor", "n", confidence.alias("confidence"))


def shared_vehicle(incidents: DataFrame, vehicle: Column) -> DataFrame:
    return shared(incidents, F.regexp_replace(F.upper(vehicle.cast("string")), " ", ""), "shared_vehicle", 2, 0.88, 0.45, 0.13, 0.05)


def shared_device(incidents: DataFrame, device: Column) -> DataFrame:
    return shared(incidents, device, "shared_device", 2, 0.85, 0.45, 0.14)


def concentration(incidents: DataFrame, place: Column) -> DataFrame:
    return shared(incidents, place, "location_concentration", 3, 0.80, 0.35, 0.11)


def common_subject(incidents: DataFrame, subject: Column) -> DataFrame:
    return shared(incidents, subject, "common_subject", 3, 0.82, 0.40, 0.10)


def findings(incidents: DataFrame, vehicle: Column, device: Column, place: Column, subject: Column) -> DataFrame:
    """All kinds as one table."""
    return shared_vehicle(incidents, vehicle).union(shared_device(incidents, device)).union(concentration(incidents, place)).union(common_subject(incidents, subject))


#: Encounters that a cell of encounters() holds about, and the blocks of ids at least.
CELL_PAIRS, LEAST_BLOCKS = 2_000_000, 4


def encounters(slots: DataFrame, largest: int = CELL_PAIRS) -> DataFrame:
    """(cell, a, b, location, day, time) for a < b in one slot; slots: different (uid, location, day) with a time, the earlier of two stays.

    All rows of a pair are in one cell, and a cell in one task, so sums by (cell, a, b) need no shuffle. Ids are
    dealt to blocks by hash, and a cell holds the slots of two blocks: shuffled are the slots, once for each block, in
    place of the pairs, which grow with the square of a slot's ids. A crowded slot is dealt evenly over all cells.
    """
    slots = stored(slots.where("uid is not null and location is not null and day is not null"), "slots")
    pairs = slots.groupBy("location", "day").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(2 * pairs / largest)))
    own = slots.withColumn("own", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = F.col("own") <= F.col("other")
    dealt = dealt.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"), (F.col("own") == F.col("other")).alias("same"), first.alias("first"), "uid", "location", "day", "time")
    dealt = dealt.repartition(blocks * (blocks + 1) // 2, "cell")
    one = F.struct("uid", "time")
    met = dealt.groupBy("cell", "location", "day").agg(F.first("same").alias("same"), F.collect_list(F.when(F.col("first"), one)).alias("xs"), F.collect_list(F.when(~F.col("first"), one)).alias("ys"))
    met = met.select("cell", "location", "day", "same", F.explode("xs").alias("x"), F.when(F.col("same"), F.col("xs")).otherwise(F.col("ys")).alias("ys"))
    met = met.select("cell", "location", "day", "same", "x", F.explode("ys").alias("y")).where("not same or x.uid < y.uid")
    return met.select("cell", F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"), "location", "day", F.least("x.time", "y.time").alias("time"))


#: Bits of a slot's number that hold its day.
DAY_BITS = 23


def _pairs_of(n: str) -> Column:
    return F.sum(F.col(n) * (F.col(n) - 1) / 2)


def _met_twice(slots: DataFrame, linked: Column, most: float) -> DataFrame | None:
    """(a, b, slots, locations, days, times) of pairs for whom linked doesn't hold and that share two slots or more; None if that takes more pairs than `most`.

    Ids meet at each two of their slots, not at each one: where few of those that meet once meet again, these pairs are
    few. Of a pair's twos only the first counts; the rest is read from both lists of slots.
    """
    by_id = slots.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")
    if (by_id.agg(_pairs_of("n")).first()[0] or 0) > most:
        return None
    places = stored(numbered(slots.select("location").distinct(), [F.col("location")], "place"), "places")
    slot = F.shiftleft("place", DAY_BITS) + F.unix_date("day") + (1 << (DAY_BITS - 1))
    lists = slots.join(places.hint("merge"), "location").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(slot.alias("slot"), "time"))).alias("own")).where(F.size("own") > 1)
    lists = stored(lists.select("uid", F.col("own.slot").alias("slots"), F.col("own.time").alias("times")), "lists")
    twos = lists.select("uid", "slots", "times", F.posexplode("slots").alias("at", "first"))
    twos = twos.select("uid", "slots", "times", "first", F.explode(F.slice("slots", F.col("at") + 2, F.size("slots"))).alias("second"))
    if (twos.groupBy("first", "second").agg(F.count("*").alias("n")).agg(_pairs_of("n")).first()[0] or 0) > most:
        return None
    side = lambda end, x: twos.select("first", "second", F.col("uid").alias(end), F.col("slots").alias(f"slots_{x}"), F.col("times").alias(f"times_{x}"))
    met = side("a", "x").hint("merge").join(side("b", "y"), ["first", "second"]).where("a < b").where(~linked)
    common = F.array_intersect("slots_x", "slots_y")
    kept = ("a", "b", "first", "second", "slots_x", "slots_y", "times_x", "times_y")
    # a generator, below which no filter moves: it would intersect again
    met = met.select(*kept, F.explode(F.array(common)).alias("common")).where((F.get("common", F.lit(0)) == F.col("first")) & (F.get("common", F.lit(1)) == F.col("second")))
    at = lambda x, s: F.element_at(f"times_{x}", F.array_position(f"slots_{x}", s).cast("int"))
    different = lambda f, name: F.size(F.array_distinct(F.transform("common", f))).cast("long").alias(name)
    return met.select(
        "a", "b", F.size("common").cast("long").alias("slots"), different(lambda s: F.shiftright(s, DAY_BITS), "locations"), different(lambda s: s.bitwiseAND((1 << DAY_BITS) - 1), "days"),
        F.sort_array(F.transform("common", lambda s: F.least(at("x", s), at("y", s)))).alias("times"),
    )


def repeated_encounters(events: DataFrame, linked: DataFrame | Column, least: float = 0.55) -> DataFrame:
    """Events (uid, location, at) to pairs that met again and again though they aren't linked: rows (a, b), or a rule over a and b.

    A slot is a location and day, counted once. Escalating: the later half of the slots took less time than the
    earlier half. Confidence: .28 + .14 a location + .09 a day + .08 if escalating, at most .90.
    """
    slots = events.select("uid", "location", F.to_date("seen_at").alias("day"), F.col("seen_at").alias("time")).groupBy("uid", "location", "day").agg(F.min("time").alias("time"))
    slots = slots.where("uid is not null and location is not null and day is not null").withColumn("time", F.unix_seconds(F.col("time").cast("timestamp")))
    slots = stored(slots, "slots")
    rule = linked if isinstance(linked, Column) else F.lit(False)
    pairs = slots.groupBy("location", "day").agg(F.count("*").alias("n")).agg(_pairs_of("n")).first()[0] or 0
    grouped = _met_twice(slots, rule, pairs)
    if grouped is None:
        met = encounters(slots).where(~rule).groupBy("cell", "a", "b").agg(F.collect_list(F.struct("time", "location", "day")).alias("met")).where(F.size("met") >= 2)
        different = lambda c: F.size(F.array_distinct(F.col(f"met.{c}"))).cast("long").alias(f"{c}s")
        grouped = met.select("a", "b", F.size("met").cast("long").alias("slots"), different("location"), different("day"), F.sort_array("met.time").alias("times"))
    if not isinstance(linked, Column):
        grouped = grouped.join(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    t, n = F.col("times"), F.size("times")
    mid = F.element_at(t, (F.floor(n / 2) + 1).cast("int"))
    span = lambda x: F.when(F.floor(x / 86_400) == 0, 1).otherwise(F.floor(x / 86_400))
    escalating = (n >= 3) & (span(F.element_at(t, -1) - mid) < span(mid - F.element_at(t, 1)))
    confidence = F.least(F.lit(0.90), 0.28 + 0.14 * F.col("locations") + 0.09 * F.col("days") + 0.08 * escalating.cast("int"))
    out = grouped.withColumns({"escalating": escalating, "confidence": confidence})
    out = out.where((F.col("slots") >= 2) & ((F.col("locations") >= 2) | (F.col("days") >= 2))).drop("times")
    return out.where(F.col("confidence") >= least) if least > 0.28 else out  # no pair has less
