"""Which devices sit at which business objects, and which events those objects take part in.

A reading belongs to a business object when its location is the object's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.folders import type_folder
from sensorthread.schema import NO_OBJECT, TYPE_FOLDER


def source_iot(readings: DataFrame, device_type: str) -> DataFrame:
    """Readings of the type; of combined readings only the folder that the type is in is read."""
    chosen = F.col("device_type") == device_type
    if TYPE_FOLDER in readings.columns:
        chosen &= F.col(TYPE_FOLDER) == type_folder(F.lit(device_type))
    return readings.where(chosen).drop(TYPE_FOLDER)


def device_places(readings: DataFrame) -> DataFrame:
    """Distinct (device_id, location): partial aggregation keeps the shuffle to one row per pair and task."""
    return readings.select("device_id", "location").distinct()


def device_object_map(readings: DataFrame, objects: DataFrame, object_types: DataFrame) -> DataFrame:
    """One row per device and place, with the type of the object there, if any."""
    typed = objects.join(object_types.select("ocel_type", "ocel_type_map"), "ocel_type", "left").select(
        F.col("ocel_id").alias("location"),
        "ocel_type",
        "ocel_type_map",
        F.concat(F.lit("object_"), "ocel_type_map").alias("object_table_name"),
    )
    return (
        device_places(readings)
        .join(typed, "location", "left")
        .select("device_id", "location", "ocel_type", "ocel_type_map", "object_table_name")
    )


def device_event_map(
    readings: DataFrame, event_object: DataFrame, events: DataFrame, event_types: DataFrame
) -> DataFrame:
    """One row per device, place and event of the object there; devices without events keep a row.

    Relations get their event type before they meet the devices, so the rows that fan out (every device of a
    place against every event there) are made in the last join and not shuffled again.
    """
    typed = events.join(event_types.select("ocel_type", "ocel_type_map"), "ocel_type", "left").select(
        F.col("ocel_id").alias("ocel_event_id"),
        "ocel_type",
        "ocel_type_map",
        F.concat(F.lit("event_"), "ocel_type_map").alias("event_table_name"),
    )
    related = event_object.select(F.col("ocel_object_id").alias("location"), "ocel_event_id").join(
        typed, "ocel_event_id", "left"
    )
    columns = ["device_id", "location", "ocel_event_id", "ocel_type", "ocel_type_map", "event_table_name"]
    places = device_places(readings)
    # Adaptive execution splits either side of an inner join, also the place with most of the events, but not the right
    # side of a left join. Devices without events come by themselves.
    met = places.join(related, "location").select(*columns)
    eventful = related.select("location").distinct()
    bare = places.join(eventful, "location", "left_anti")
    empty = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in columns[2:]]
    return met.unionAll(bare.select("device_id", "location", *empty))


def refine_source(
    readings: DataFrame, device_type: str, objects: DataFrame, object_type: str, places: DataFrame | None = None
) -> DataFrame:
    """Readings of a device type, kept when their device is seen at an object of the given type. A device
    that is at such an object once keeps all its readings. `places`: the distinct places of the readings, if there is a
    table of them."""
    source = source_iot(readings, device_type)
    if object_type == NO_OBJECT:
        return source
    at_type = objects.where(F.col("ocel_type") == object_type).select(F.col("ocel_id").alias("location"))
    seen = source if places is None else source_iot(places, device_type)
    devices = device_places(seen).join(at_type, "location", "left_semi").select("device_id").distinct()
    return source.join(devices, "device_id", "left_semi")


def potential_pairs(readings: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct (device_type, object type or NONE)."""
    typed = objects.select(F.col("ocel_id").alias("location"), "ocel_type")
    return (
        readings.select("device_type", "location")
        .distinct()
        .join(typed, "location", "left")
        .select("device_type", F.coalesce("ocel_type", F.lit(NO_OBJECT)).alias("ocel_type"))
        .distinct()
    )


def remaining_pairs(readings: DataFrame, objects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Potential pairs the ledger does not hold. A null device type never matches the ledger."""
    done = ledger.select("device_type", "ocel_type")
    return potential_pairs(readings, objects).join(done, ["device_type", "ocel_type"], "left_anti")


def remaining_device_types(readings: DataFrame, objects: DataFrame, ledger: DataFrame) -> DataFrame:
    return (
        remaining_pairs(readings, objects, ledger)
        .where(F.col("device_type").isNotNull())
        .select("device_type")
        .distinct()
        .orderBy("device_type")
    )


def remaining_count(readings: DataFrame, objects: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many pairs remain, and how many of them can never be ticked off for want of a device type."""
    return remaining_pairs(readings, objects, ledger).agg(
        F.count(F.lit(1)).alias("remaining"),
        F.count_if(F.col("device_type").isNull()).alias("without_device_type"),
    )


def object_type_status(object_map: DataFrame, ledger: DataFrame, device_type: str) -> DataFrame:
    """Object types a device type maps to, marked by whether the ledger holds them."""
    done = (
        ledger.where(F.col("device_type") == device_type)
        .select("ocel_type", F.lit(True).alias("_done"))
        .distinct()
    )
    return (
        object_map.where(F.col("ocel_type").isNotNull())
        .select("ocel_type")
        .distinct()
        .join(done, "ocel_type", "left")
        .select("ocel_type", F.when(F.col("_done"), "integrated").otherwise("pending").alias("status"))
        .orderBy("ocel_type")
    )


def mapped_event_types(readings: DataFrame, event_object: DataFrame, events: DataFrame) -> DataFrame:
    """Types of the events the devices map to, without building the device-event map."""
    places = readings.select(F.col("location").alias("ocel_object_id")).distinct()
    ids = event_object.join(places, "ocel_object_id", "left_semi").select(
        F.col("ocel_event_id").alias("ocel_id")
    )
    return (
        events.where(F.col("ocel_type").isNotNull())
        .join(ids, "ocel_id", "left_semi")
        .select("ocel_type")
        .distinct()
        .orderBy("ocel_type")
    )


def valid_event_types(events: DataFrame, event_types: DataFrame | None = None) -> DataFrame:
    """All event types, from the type table or, where a log has none, from the events."""
    source = events if event_types is None else event_types
    return source.select("ocel_type").distinct().orderBy("ocel_type")


def iot_properties(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("property").isNotNull()).select("property").distinct().orderBy("property")
