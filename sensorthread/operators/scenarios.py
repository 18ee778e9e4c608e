"""From readings to the payload that is written into the log.

Scenario A: object attributes, readings taken exactly when an event of the object happens.
Scenario B: object attributes, no events involved.
Scenario C: event attributes, readings of the last n minutes before the event.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.aggregates import BUILT_IN, aggregate_name
from sensorthread.functions.clock import MINUTE, micros, naive, time_bucket
from sensorthread.operators.log import EventLog
from sensorthread.operators.lookback import Measure, lookback_states, lookback_stretches, within_stretches
from sensorthread.operators.maps import device_places
from sensorthread.operators.ordered import HOT_ROWS, group_median, packed
from sensorthread.operators.window_median import ARRAY_ROWS, window_medians
from sensorthread.session import written

CLOSEST_LOOKBACK = 60  # Fixed value: minutes a reading may be older than the event it is picked for.

READING = ["device_id", "device_type", "location", "property"]


class Scenario(Enum):
    OBJECT_AT_EVENTS = "A"
    OBJECT = "B"
    EVENT = "C"


def choose_scenario(attribute_type: str, associations: list) -> Scenario:
    """Attribute type 1 is an object attribute (A with associated events, B without), 2 an event attribute."""
    if attribute_type == "1":
        return Scenario.OBJECT_AT_EVENTS if associations else Scenario.OBJECT
    if attribute_type == "2":
        return Scenario.EVENT
    raise ValueError(f"unknown attribute type {attribute_type!r}")


def aggregate_values(
    df: DataFrame, keys: list[str], func: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`property_value` as the named aggregate of its values, per key."""
    func = aggregate_name(func)
    valued = df.withColumn("property_value", F.col("property_value").cast("double"))
    if func == "median":
        return group_median(valued, keys, "property_value", "property_value", hot_rows)
    value = BUILT_IN[func]("property_value").cast("double").alias("property_value")
    return valued.groupBy(*keys).agg(value)


# Scenario B


def object_payload(readings: DataFrame, keep: Column | None = None) -> DataFrame:
    chosen = readings if keep is None else readings.where(keep)
    return chosen.select(*READING, "property_value", naive("result_time").alias("result_time"))


def object_payload_by_window(readings: DataFrame, func: str, width: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One value per reading key and bucket of `width` minutes, timed at the last reading in the bucket."""
    keys = [*READING, "time_window"]
    timed = readings.select(*READING, "property_value", naive("result_time").alias("result_time")).withColumn(
        "time_window", time_bucket("result_time", width)
    )
    name = aggregate_name(func)
    if name != "median":
        value = BUILT_IN[name](F.col("property_value").cast("double")).cast("double")
        return timed.groupBy(*keys).agg(
            F.max("result_time").alias("result_time"), value.alias("property_value")
        )
    last = timed.groupBy(packed(keys).alias("_key")).agg(F.max("result_time").alias("result_time"))
    medians = aggregate_values(timed, keys, func, hot_rows).select(
        packed(keys).alias("_key"), "property_value"
    )
    return last.join(medians, "_key").select("_key.*", "result_time", "property_value")


# Scenario A


def _held_places(readings: DataFrame, log: EventLog) -> DataFrame:
    """(device_id, place) for the places that take part in events."""
    places = device_places(readings).select("device_id", F.col("location").alias("place"))
    eventful = log["event_object"].select(F.col("ocel_object_id").alias("place"))
    return places.join(eventful, "place", "left_semi")


def readings_at_events(
    readings: DataFrame, log: EventLog, event_types: list[str], once: bool = False, places: DataFrame | None = None
) -> DataFrame:
    """Readings joined to the events their device maps to, at equal times.

    A device that maps to an event in two ways gives the reading twice, unless `once`. Which device meets
    which event when is settled on distinct (device, time) rows; the readings join in last. `places`, here and below: the
    distinct places of the readings, if there is a table of them.
    """
    events = log.related_events(event_types).select("ocel_event_id", "place", "event_time")
    timed = readings.withColumn("result_time", naive("result_time"))
    meetings = (
        timed.select("device_id", F.col("result_time").alias("event_time"))
        .distinct()
        .join(_held_places(readings if places is None else places, log), "device_id")
        .join(events, ["place", "event_time"])
        .select("device_id", F.col("event_time").alias("result_time"), "ocel_event_id")
    )
    if once:
        meetings = meetings.distinct()
    return timed.join(meetings, ["device_id", "result_time"]).select(
        *READING, "property_value", "ocel_event_id", "result_time"
    )


def object_payload_at_events(
    readings: DataFrame,
    log: EventLog,
    event_types: list[str],
    keep: Column | None = None,
    once: bool = False,
    places: DataFrame | None = None,
) -> DataFrame:
    joined = readings_at_events(readings, log, event_types, once, places)
    return joined if keep is None else joined.where(keep)


def object_payload_by_event(
    readings: DataFrame,
    log: EventLog,
    event_types: list[str],
    func: str,
    once: bool = False,
    hot_rows: int = HOT_ROWS,
    places: DataFrame | None = None,
) -> DataFrame:
    """One value per event and reading key. The join is on equal times, so no window is left to apply."""
    joined = readings_at_events(readings, log, event_types, once, places)
    return aggregate_values(joined, [*READING, "ocel_event_id", "result_time"], func, hot_rows)


# Scenario C


def _with_span(df: DataFrame, lookback: int) -> DataFrame:
    """Number of the lookback-long span a time falls in; a window reaches into its own span and the one before."""
    width = lookback * MINUTE
    return df.withColumn("span", F.expr(f"(us - pmod(us, {width})) div {width}") if width else F.col("us"))


def _active_spans(readings: DataFrame, cols: list[str], lookback: int) -> DataFrame:
    """Distinct (cols, span) in which a window can end and still see a reading."""
    spans = _with_span(readings, lookback).select(*cols, "span").distinct()
    if lookback == 0:
        return spans
    return spans.withColumn("span", F.explode(F.array(F.col("span"), F.col("span") + 1))).distinct()


def _seen_spans(times: DataFrame, lookback: int) -> DataFrame:
    """Distinct spans whose readings a window that ends at one of the times may see."""
    spans = _with_span(times, lookback).select("span").distinct()
    if lookback == 0:
        return spans
    return spans.select(F.explode(F.array(F.col("span") - 1, F.col("span"))).alias("span")).distinct()


def _probes(readings: DataFrame, times: DataFrame, by: list[str], lookback: int) -> DataFrame:
    """(key, us) for each time in `times` (by, us) and each key of `readings` (key, by, us) that may match."""
    active = _active_spans(readings, ["key", *by], lookback)
    return _with_span(times, lookback).join(active, [*by, "span"]).select("key", "us")


def _timed(readings: DataFrame) -> DataFrame:
    return readings.withColumn("us", micros(naive("result_time")))


def _target_events(log: EventLog, event_type: str) -> DataFrame:
    return log.event_times([event_type]).select(
        F.col("ocel_id").alias("ocel_event_id"),
        F.col("ocel_time").alias("result_time"),
        micros("ocel_time").alias("us"),
    )


def _related(log: EventLog, event_type: str) -> DataFrame:
    return log.related_events([event_type]).select(
        "ocel_event_id", "place", F.col("event_time").alias("result_time"), micros("event_time").alias("us")
    )


def is_mapped(readings: DataFrame, log: EventLog, event_type: str) -> bool:
    """Whether any device sits at an object that takes part in an event of the type."""
    events = log["event"].where(F.col("ocel_type") == event_type).select(F.col("ocel_id").alias("ocel_event_id"))
    places = (
        log["event_object"]
        .join(events, "ocel_event_id", "left_semi")
        .select(F.col("ocel_object_id").alias("location"))
    )
    return not readings.select("location").join(places, "location", "left_semi").isEmpty()


def matches_before_events(
    readings: DataFrame,
    log: EventLog,
    event_type: str,
    lookback: int,
    mapped: bool,
    hot_rows: int = HOT_ROWS,
    places: DataFrame | None = None,
) -> DataFrame:
    """How many readings of the last `lookback` minutes each event meets, and the earliest and latest of them.

    This is the relation the picks and aggregates below work on, described without listing it.
    """
    timed = _timed(readings)
    if mapped:
        events = _related(log, event_type)
        per_device = timed.groupBy("device_id", "us").agg(F.count(F.lit(1)).alias("n"))
        at_places = per_device.join(_held_places(readings if places is None else places, log), "device_id")
        keyed = at_places.groupBy(F.struct("place").alias("key"), "place", "us").agg(F.sum("n").alias("n"))
        by = ["place"]
    else:
        events = _target_events(log, event_type)
        keyed = timed.groupBy("us").agg(F.count(F.lit(1)).alias("n")).select(
            F.struct(F.lit(0)).alias("key"), "us", "n"
        )
        by = []
    keyed = written(keyed, "readings")
    probes = _probes(keyed, events.select(*by, "us").distinct(), by, lookback)
    measures = {
        "n": Measure(F.col("n"), F.sum),
        "first": Measure(F.col("us"), F.min),
        "last": Measure(F.col("us"), F.max),
    }
    states = lookback_states(keyed, probes, lookback, measures, hot_rows)
    if mapped:
        states = states.withColumn("place", F.col("key.place"))
    age = "CAST((us - {0}) div 60000000 AS BIGINT)"
    return (
        events.join(states, [*by, "us"])
        .groupBy("ocel_event_id", "result_time", "us")
        .agg(F.sum("n").alias("n_readings"), F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            "ocel_event_id",
            "result_time",
            "n_readings",
            F.expr(age.format("first")).alias("oldest_minutes"),
            F.expr(age.format("last")).alias("newest_minutes"),
        )
    )


def closest_before_events(
    readings: DataFrame,
    log: EventLog,
    event_type: str,
    mapped: bool,
    lookback: int = CLOSEST_LOOKBACK,
    keep: Column | None = None,
    hot_rows: int = HOT_ROWS,
    places: DataFrame | None = None,
) -> DataFrame:
    """The newest reading per event and property, then `keep` on the picked readings only: an event whose newest
    reading fails it gets none. Equal times are settled by device_id, property_value, location, device_type,
    ascending, nulls last."""
    timed = _timed(readings)
    if mapped:
        events = _related(log, event_type)
        by = ["place"]
        keyed = timed.join(_held_places(readings if places is None else places, log), "device_id").withColumn(
            "key", F.struct("place", "property")
        )
    else:
        events = _target_events(log, event_type)
        by = []
        keyed = timed.withColumn("key", F.struct("property"))

    ordered = [
        part
        for c in ("device_id", "property_value", "location", "device_type")
        for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))
    ]
    # The windows carry only the newest time, from distinct keys and times, which are grouped by hash. Which reading that
    # is, and which of equally new ones, is settled among the readings of the few picked times.
    moments = written(keyed.select(*by, "key", "us").distinct(), "moments")
    probes = _probes(moments, events.select(*by, "us").distinct(), by, lookback)
    newest = lookback_states(moments, probes, lookback, {"last": Measure(F.col("us"), F.max)}, hot_rows)
    newest = written(newest, "newest")
    wanted = newest.select("key", F.col("last").alias("us")).distinct()
    best = keyed.join(wanted, ["key", "us"], "left_semi").groupBy("key", "us").agg(F.min(F.struct(*ordered)).alias("best"))
    picks = newest.join(best.withColumnRenamed("us", "last"), ["key", "last"])
    if mapped:
        picks = picks.withColumn("place", F.col("key.place"))
    # An event with several objects has one pick per object; the least (age, reading) is the event's.
    chosen = (
        events.join(picks, [*by, "us"])
        .groupBy("ocel_event_id", "result_time", F.struct("key.property").alias("p"))
        .agg(F.min(F.struct((F.col("us") - F.col("last")).alias("age"), "best")).alias("pick"))
        .select(
            "pick.best.device_id",
            "pick.best.device_type",
            "pick.best.location",
            "p.property",
            "pick.best.property_value",
            "ocel_event_id",
            "result_time",
        )
    )
    return chosen if keep is None else chosen.where(keep)


def aggregate_before_events(
    readings: DataFrame,
    log: EventLog,
    event_type: str,
    func: str,
    lookback: int,
    mapped: bool,
    once: bool = False,
    hot_rows: int = HOT_ROWS,
    places: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """One value per event and reading key over the last `lookback` minutes, rounded to `digits` decimals if given.

    A device that maps to an event in two ways counts its readings twice in sums and counts, unless `once`.
    """
    func = aggregate_name(func)
    keyed = _timed(readings).select(
        packed(READING).alias("key"), "device_id", "us", F.col("property_value").cast("double").alias("v")
    )
    weighted = {
        "sum": F.col("total") * F.col("times"),
        "count": (F.col("n") * F.col("times")).cast("double"),
        "stddev": F.when(
            F.col("n") * F.col("times") > 1,
            F.sqrt(F.col("times") * F.col("spread") / (F.col("n") * F.col("times") - 1)),
        ),
    }
    value = weighted.get(func, F.col("value"))
    if digits is not None:
        value = F.round(value, digits)
    if mapped:
        events = _related(log, event_type)
        times = events.select("place", "us").distinct()
        met = written(
            _active_spans(keyed, ["device_id"], lookback)
            .join(_held_places(readings if places is None else places, log), "device_id")
            .join(_with_span(times, lookback), ["place", "span"])
            .select("device_id", "place", "us"),
            "met",
        )
        probes = _probes(keyed, met.select("device_id", "us").distinct(), ["device_id"], lookback)
        targets = (
            events.join(met, ["place", "us"])
            .groupBy("device_id", "us", "ocel_event_id", "result_time")
            .agg((F.lit(1) if once else F.count(F.lit(1))).alias("times"))
        )
        values = _window_values(keyed, probes, lookback, func, hot_rows).withColumn("device_id", F.col("key.device_id"))
        joined = targets.join(values, ["device_id", "us"]).withColumn("property_value", value).select(
            "key.*", "property_value", "ocel_event_id", "result_time"
        )
    elif func == "median":
        events = _target_events(log, event_type)
        probes = _probes(keyed, events.select("us").distinct(), [], lookback)
        values = _window_values(keyed, probes, lookback, func, hot_rows)
        joined = values.select("key.*", "us", value.alias("property_value")).join(events, "us")
    else:
        # Every event meets every key read of late, so there are as many rows as pairs of them. Only the last join makes
        # them: before it, values are settled for stretches of time, whose number depends on the readings alone.
        events = _target_events(log, event_type)
        seen = _seen_spans(events.select("us"), lookback)
        near = _with_span(keyed, lookback).join(seen, "span", "left_semi").drop("span")
        near, measures, derived = _window_parts(near, func)
        stretches = lookback_stretches(near, lookback, measures, hot_rows).withColumns({"times": F.lit(1), **derived})
        flat = stretches.select("key.*", value.alias("property_value"), "since", "until")
        joined = within_stretches(flat, events, lookback)
    return joined.select(*READING, "property_value", "ocel_event_id", "result_time")


def _window_parts(keyed: DataFrame, func: str) -> tuple[DataFrame, dict[str, Measure], dict[str, Column]]:
    """The readings, the states of their windows, and what is derived from these: `value`, or for functions that depend
    on repeats, the parts they are made of."""
    v = F.col("v")
    one = F.when(v.isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    if func in ("max", "min"):
        return keyed, {"value": Measure(v, BUILT_IN[func])}, {}
    if func == "stddev":
        # Squares are taken around the mean of the key, which keeps them small.
        means = keyed.groupBy("key").agg(F.avg("v").alias("center"))
        off = v - F.col("center")
        parts = {
            "n": Measure(one, F.sum),
            "off": Measure(off, F.sum),
            "square": Measure(off * off, F.sum),
        }
        spread = F.greatest(F.col("square") - F.col("off") * F.col("off") / F.nullif("n", F.lit(0)), F.lit(0.0))
        return keyed.join(means, "key"), parts, {"spread": spread}
    parts = {"n": Measure(one, F.sum), "total": Measure(v, F.sum)}
    return keyed, parts, {"value": F.col("total") / F.nullif("n", F.lit(0))}


def _window_values(
    keyed: DataFrame, probes: DataFrame, lookback: int, func: str, hot_rows: int
) -> DataFrame:
    """What `_window_parts` names, per probe."""
    if func == "median":
        return window_medians(keyed, probes, lookback, min(hot_rows, ARRAY_ROWS))
    keyed, measures, derived = _window_parts(keyed, func)
    return lookback_states(keyed, probes, lookback, measures, hot_rows).withColumns(derived)
