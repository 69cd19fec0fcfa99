"""Raised signals: the SOS row, the first row of its history, and the alert that is linked to it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import places

CONTACTS, REACH_KM = 3, 10.0


class Raised(NamedTuple):
    sos: DataFrame
    history: DataFrame
    alerts: DataFrame


def raised(signals: DataFrame, zones: DataFrame, services: DataFrame) -> Raised:
    """The tables that signals (sos_id, subject_name, note, lat, lng, raised_at) give rise to.

    zones (zone_id, clat, clng): the nearest one is the signal's. services (service_id, clat, clng): the nearest three
    within ten kilometres are its contacts, nearest first; none in reach: an empty list. A signal without a place has
    neither. Every signal has one row in each table.
    """
    at = signals.where("lat is not null and lng is not null").select("sos_id", "lat", "lng")
    three = places.closest(at, services, "sos_id", "service_id", CONTACTS, REACH_KM)
    called = three.groupBy("sos_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "service_id"))), lambda r: r["service_id"]).alias("contacts"))
    near = places.nearest(at, zones, "sos_id", "zone_id").select("sos_id", "zone_id")
    sos = signals.join(near, "sos_id", "left").join(called, "sos_id", "left").withColumn("status", F.lit("RECEIVED")).withColumn("sos_ref", F.format_string("SOS-%04d", "sos_id"))
    sos = sos.withColumn("contacts", F.coalesce("contacts", F.array().cast(called.schema["contacts"].dataType)))
    history = signals.select("sos_id", F.lit(None).cast("string").alias("from_status"), F.lit("RECEIVED").alias("to_status"), F.col("raised_at").alias("changed_at"))
    alerts = sos.select(
        F.format_string("A-SOS-%04d", "sos_id").alias("alert_ref"), "sos_id", "sos_ref", "zone_id", "raised_at", F.lit("CRITICAL").alias("priority"), F.lit("NEW").alias("status"),
        F.concat(F.lit("SOS raised by "), F.coalesce("subject_name", F.lit("an unnamed person"))).alias("message"), F.coalesce("note", F.lit("One-tap SOS alert awaiting assignment.")).alias("detail"),
    )
    return Raised(sos, history, alerts)
