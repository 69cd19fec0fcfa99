"""Zones, distances and routes. Range joins go through grid cells, so no pair beyond neighbouring cells is made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.storage import stored


def _cells(value: Column, reach: Column, degrees: float) -> Column:
    return F.sequence(geo.cell(value - reach, degrees), geo.cell(value + reach, degrees))


def within(points: DataFrame, centres: DataFrame, radius: Column, degrees: float = 0.05) -> DataFrame:
    """Points (lat, lng, ...) with each centre (clat, clng, ...) no farther than radius km (a column of centres), and distance.

    Each centre is listed under the cells that its bounding box touches; points join by their own cell.
    """
    km = radius / geo.KM_PER_DEGREE
    wide = km / F.cos(F.radians(F.least(F.abs("clat") + km, F.lit(89.0))))
    listed = centres.withColumn("cx", F.explode(_cells(F.col("clat"), km, degrees))).withColumn("cy", F.explode(_cells(F.col("clng"), wide, degrees))).withColumn("reach", radius)
    placed = points.where("lat is not null and lng is not null").withColumns({"px": geo.cell(F.col("lat"), degrees), "py": geo.cell(F.col("lng"), degrees)})
    joined = placed.join(listed, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")))
    joined = joined.withColumn("distance", geo.haversine(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng")))
    return joined.where("distance <= reach").drop("cx", "cy", "px", "py", "reach")


def nearest(points: DataFrame, centres: DataFrame, key: str, ident: str, reaches: tuple[float, ...] = (16.0, 256.0, 20_040.0)) -> DataFrame:
    """(key, ident, distance): each point's nearest centre (ident, clat, clng); ties go to the smaller ident.

    Points without a centre in the first reach (km) go on to the next; the last spans the earth.
    """
    found, left = None, points
    for reach in reaches:
        near = within(left, centres, F.lit(reach), max(0.05, reach / 64))
        best = near.groupBy(key).agg(F.min(F.struct("distance", ident)).alias("best")).select(key, F.col("best")[ident].alias(ident), F.col("best")["distance"].alias("distance"))
        found = best if found is None else found.union(best)
        left = left.join(best, key, "left_anti")
    return found


#: Places that the first reach of closest() holds about, where they stand closest.
FIRST_PLACES = 12


def closest(points: DataFrame, centres: DataFrame, key: str, ident: str, k: int, reach: float) -> DataFrame:
    """(key, ident, distance, p): the k nearest centres (ident, clat, clng) of each point within reach km, p from 1; ties go to the smaller ident.

    Of centres at one place only the k smallest can be among them. The first reach is chosen by how close places stand, and
    points with fewer than k centres in a reach go on to one twice as long, so the pairs of a point don't grow with the centres.
    """
    first = Window.partitionBy("clat", "clng").orderBy(ident)
    centres = stored(centres.withColumn("p", F.row_number().over(first)).where(F.col("p") <= k).drop("p"), "centres")
    cell = centres.select("clat", "clng").distinct().groupBy(geo.cell(F.col("clat"), 0.05).alias("x"), geo.cell(F.col("clng"), 0.05).alias("y")).count()
    most = cell.agg(F.max("count")).first()[0] or 1
    halves = max(0, math.floor(math.log2(reach / (0.05 * geo.KM_PER_DEGREE * math.sqrt(FIRST_PLACES / (math.pi * most))))))
    order = Window.partitionBy(key).orderBy("distance", ident)
    found, left = None, stored(points, "points")
    for step in range(halves, -1, -1):
        limit = reach / 2**step
        near = within(left, centres, F.lit(limit), min(0.05, 2 * limit / geo.KM_PER_DEGREE)).withColumn("p", F.row_number().over(order)).where(F.col("p") <= k)
        best = stored(near.select(key, ident, "distance", "p"), "closest")
        done = best.where(F.col("p") == k).select(key)
        own = best.join(done, key, "left_semi") if step else best
        found = own if found is None else found.union(own)
        left = left.join(done, key, "left_anti")
    return found


def heatmap(incidents: DataFrame, zones: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted kernel density of each zone, its share of the largest, and bands.

    An incident adds to every zone within one and a half radii; one without a place to its own zone in full.
    It counts as of a zone where its kernel is over a quarter.
    """
    weight = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))[F.col("priority")], F.lit(1.0))
    own = incidents.select("incident_id", "lat", "lng", F.col("zone_id").alias("home"), weight.alias("weight"))
    centres = zones.select("zone_id", F.col("zlat").alias("clat"), F.col("zlng").alias("clng"), "radius")
    near = within(own, centres, F.col("radius") * 1.5).select("zone_id", "weight", geo.kernel(F.col("distance"), F.col("radius")).alias("k"))
    lost = own.where("lat is null or lng is null").select(F.col("home").alias("zone_id"), "weight", F.lit(1.0).alias("k"))
    sums = near.union(lost).groupBy("zone_id").agg(F.sum(F.col("weight") * F.col("k")).alias("weighted"), F.count_if(F.col("k") > 0.25).alias("incidents"))
    out = zones.join(sums, "zone_id", "left").withColumn("density", F.coalesce("weighted", F.lit(0.0)) / geo.zone_area(F.col("radius")))
    peak = out.agg(F.max("density").alias("peak"))
    out = out.crossJoin(F.broadcast(peak))  # one row
    share = F.when(F.col("peak") > 0, F.col("density") / F.col("peak")).otherwise(0.0)
    return out.select(
        "zone_id",
        "zone",
        F.coalesce("incidents", F.lit(0)).alias("incidents"),
        "density",
        share.alias("share"),
        geo.band(share, geo.HEAT_BANDS, "GREEN").alias("band"),
        geo.band(F.col("density"), geo.DENSITY_BANDS, "GREEN").alias("absolute_band"),
    )


def segment_metrics(segments: DataFrame, incidents: DataFrame, services: DataFrame, weights: dict[str, float], reach: float = 0.6) -> DataFrame:
    """Segments (seg, alat, alng, blat, blng) with km, the incident pressure and the nearest service about their middles."""
    s = segments.withColumns({"km": geo.haversine(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng")), "clat": (F.col("alat") + F.col("blat")) / 2, "clng": (F.col("alng") + F.col("blng")) / 2})
    weight = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))[F.col("priority")], F.lit(1.0))
    near = within(incidents.select("lat", "lng", weight.alias("weight")), s.select("seg", "clat", "clng"), F.lit(reach))
    pressure = near.groupBy("seg").agg(F.sum(F.col("weight") * (1 - F.col("distance") / reach)).alias("pressure"))
    middle = s.select("seg", F.col("clat").alias("lat"), F.col("clng").alias("lng"))
    closest = nearest(middle, services.select("service_id", F.col("slat").alias("clat"), F.col("slng").alias("clng")), "seg", "service_id")
    out = s.join(pressure, "seg", "left").join(closest.select("seg", F.col("distance").alias("service_km")), "seg", "left")
    return out.withColumns({"pressure": F.coalesce("pressure", F.lit(0.0)), "service_km": F.coalesce("service_km", F.lit(5.0))}).drop("clat", "clng")


def segment_cost(hour: Column, unlit: Column, alert: Column) -> Column:
    """A segment's cost from km, pressure, service_km, the hour, whether it's unlit and whether an alert is recent."""
    return F.col("km") * geo.night_factor(hour) * (1 + 0.22 * F.col("pressure")) * (1 + 0.30 * unlit.cast("int")) * (1 + 0.25 * alert.cast("int")) + 0.12 * F.col("service_km")


def ranked_routes(paths: DataFrame, segments: DataFrame, k: int = 3) -> DataFrame:
    """The k cheapest of paths (src, dst, path, cost) of each pair, scored and ranked anew by score.

    segments: (u, v, km) in both directions. The score is advisory; no route is called safe.
    """
    order = Window.partitionBy("src", "dst").orderBy("cost", F.size("path"), "path")
    best = paths.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    steps = best.select("src", "dst", "place", "cost", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "u")).withColumn("v", F.element_at("path", F.col("i") + 2))
    length = steps.join(segments.select("u", "v", "km"), ["u", "v"]).groupBy("src", "dst", "place").agg(F.sum("km").alias("km"))
    out = best.join(length, ["src", "dst", "place"])
    score = F.greatest(F.lit(5.0), F.least(F.lit(97.0), 100 - (F.col("cost") / F.greatest("km", F.lit(0.05)) - 1) * 26))
    again = Window.partitionBy("src", "dst").orderBy(F.desc("score"), "cost", "path")
    out = out.withColumn("score", F.round(score, 1)).withColumn("rank", F.row_number().over(again))
    return out.select("src", "dst", "path", "cost", "km", "score", "rank", (F.col("rank") == 1).alias("recommended"))
