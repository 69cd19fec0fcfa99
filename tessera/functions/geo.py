"""Column functions on places and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Kilometres in a degree of latitude, a little less than any true value: for bounding boxes.
KM_PER_DEGREE = 110.5


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def kernel(distance: Column, radius: Column) -> Column:
    return F.pow(F.lit(2.71828), -F.pow(distance / F.greatest(radius, F.lit(0.2)), 2))


def zone_area(radius: Column) -> Column:
    return F.greatest(F.lit(0.35), 3.14159 * radius * radius)


def cell(value: Column, degrees: float) -> Column:
    """The number of the grid cell of a coordinate."""
    return F.floor(value / degrees).cast("long")


def band(value: Column, cuts: tuple[tuple[str, float], ...], rest: str) -> Column:
    """The name of the first cut that the value reaches."""
    out = F.lit(rest)
    for name, least in reversed(cuts):
        out = F.when(value >= least, name).otherwise(out)
    return out


# fixed values: cut-offs of the bands
SCORE_BANDS = (("CRITICAL", 75.0), ("HIGH", 55.0), ("MEDIUM", 30.0))
HEAT_BANDS = (("RED", 0.75), ("ORANGE", 0.45), ("YELLOW", 0.20))
DENSITY_BANDS = (("RED", 12.0), ("ORANGE", 6.0), ("YELLOW", 2.0))


def night_factor(hour: Column) -> Column:
    return F.when((hour >= 20) | (hour <= 5), 1.45).when((hour >= 17) & (hour <= 19), 1.18).otherwise(1.0)
