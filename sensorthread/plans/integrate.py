"""One integration run: choose readings, make the payload, write it into the log, tick the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.aggregates import aggregate_name
from sensorthread.functions.conditions import Bound, Condition, threshold_predicate, value_predicate
from sensorthread.operators import maps, persist, scenarios
from sensorthread.operators.log import EventLog
from sensorthread.operators.persist import Association
from sensorthread.operators.reshape import column_names, payload_properties
from sensorthread.operators.scenarios import Scenario
from sensorthread.schema import (
    EVENT_LINK,
    EVENT_LINK_SCHEMA,
    LEDGER,
    LEDGER_SCHEMA,
    NO_OBJECT,
    OBJECT_LINK,
    OBJECT_LINK_SCHEMA,
)
from sensorthread.session import temporary
from sensorthread.sources.workspace import Change, Workspace

PAYLOAD = "processed_iot_payload"

# What a run does with the readings.
PASS, FILTER, AGGREGATE = "1", "2", "3"


# Columns of the target tables that no property may be named like.
KEY_COLUMNS = {"1": ["ocel_id", "ocel_time", "ocel_changed_field"], "2": ["ocel_id", "ocel_time"]}


@dataclass(frozen=True)
class Config:
    """What to integrate: readings of `device_type` at objects of `selected_type` (or NONE for all), written as
    attributes of the objects (`attribute_type` "1") or events ("2") of type `ocel_type`."""

    device_type: str
    ocel_type: str
    attribute_type: str = "1"
    selected_type: str = NO_OBJECT
    logic: str = PASS
    associations: tuple[Association, ...] = ()
    qualifier: str = ""
    conditions: tuple[Condition, ...] = ()
    lower: Bound = field(default_factory=Bound)
    upper: Bound = field(default_factory=Bound)
    func: str = "mean"
    window: int = 0
    once: bool = False
    interaction_level: str | None = None  # carried along; nothing depends on it


@dataclass(frozen=True)
class Result:
    """Rows written and rows that were there already, of the attributes and of the links; `all_done` says that no pair
    of device and object type is left to integrate."""

    all_done: bool
    main_inserted: int
    main_skipped: int
    links_inserted: int
    links_skipped: int

    @property
    def status(self) -> str:
        """`warning` if there was something to write and all of it existed."""
        wrote = self.main_inserted + self.links_inserted > 0
        existed = self.main_skipped + self.links_skipped > 0
        return "warning" if existed and not wrote else "success"


def _keep(config: Config) -> Column | None:
    if config.logic != FILTER:
        return None
    if config.conditions:
        return threshold_predicate(list(config.conditions))
    return value_predicate(config.lower, config.upper)


def process(readings: DataFrame, log: EventLog, config: Config, places: DataFrame | None = None) -> DataFrame:
    """The payload of a run. `places`: the distinct places of the readings, if there is a table of them."""
    if config.logic not in (PASS, FILTER, AGGREGATE):
        raise ValueError(f"unknown logic {config.logic!r}")
    scenario = scenarios.choose_scenario(config.attribute_type, list(config.associations))
    keep = _keep(config)
    aggregate = config.logic == AGGREGATE
    if aggregate:
        aggregate_name(config.func)
    if scenario is Scenario.OBJECT:
        if aggregate:
            return scenarios.object_payload_by_window(readings, config.func, config.window)
        return scenarios.object_payload(readings, keep)
    if scenario is Scenario.OBJECT_AT_EVENTS:
        types = [a.event_type for a in config.associations]
        if aggregate:
            return scenarios.object_payload_by_event(readings, log, types, config.func, config.once, places=places)
        return scenarios.object_payload_at_events(readings, log, types, keep, config.once, places)
    mapped = scenarios.is_mapped(readings if places is None else places, log, config.ocel_type)
    if aggregate:
        return scenarios.aggregate_before_events(
            readings, log, config.ocel_type, config.func, config.window, mapped, config.once, places=places
        )
    return scenarios.closest_before_events(readings, log, config.ocel_type, mapped, keep=keep, places=places)


def _or_empty(log: EventLog, name: str, schema, spark) -> DataFrame:
    return log[name] if name in log else spark.createDataFrame([], schema)


def _target_table(readings: DataFrame, log: EventLog, config: Config) -> str:
    """The table the attributes go to. An object type must be one the chosen devices map to."""
    if config.attribute_type == "2":
        return log.table_name("event", config.ocel_type)
    at_type = log["object"].where(F.col("ocel_type") == config.ocel_type).select(F.col("ocel_id").alias("location"))
    if readings.select("location").join(at_type, "location", "left_semi").isEmpty():
        raise ValueError(f"no chosen device maps to an object of type {config.ocel_type!r}")
    return log.table_name("object", config.ocel_type)


def _check_events(readings: DataFrame, log: EventLog, config: Config) -> None:
    """Readings at events need an event at a place of the chosen devices, of a type that has a table."""
    if config.attribute_type != "1" or not config.associations:
        return
    places = maps.device_places(readings).select(F.col("location").alias("ocel_object_id"))
    related = log["event_object"].join(places, "ocel_object_id", "left_semi").select("ocel_event_id")
    mapped = log["event"].join(log["event_map_type"].select("ocel_type"), "ocel_type", "left_semi")
    if related.join(mapped.select(F.col("ocel_id").alias("ocel_event_id")), "ocel_event_id", "left_semi").isEmpty():
        raise ValueError("no event of a mapped type takes place where the chosen devices are")


def integrate(readings: DataFrame, workspace: Workspace, config: Config, places: DataFrame | None = None) -> Result:
    """Run one integration on the combined readings and save all of it as one new version of the log, or nothing of it if
    it fails or another run saves first. Its intermediates are removed.

    `places`, the table that `add_places` keeps beside the readings, spares the scans of all readings that only ask which
    devices are where.
    """
    with temporary(readings.sparkSession), workspace.begin() as change:
        return _integrate(readings, change, config, places)


def _integrate(readings: DataFrame, change: Change, config: Config, places: DataFrame | None) -> Result:
    spark = readings.sparkSession
    log = change.log
    chosen = maps.refine_source(readings, config.device_type, log["object"], config.selected_type, places)
    held = None
    if places is not None:
        held = maps.refine_source(places, config.device_type, log["object"], config.selected_type)
    target = _target_table(chosen if held is None else held, log, config)
    _check_events(chosen if held is None else held, log, config)

    made = process(chosen, log, config, held)
    # Names that cannot become columns end the run before it has written anything.
    column_names(payload_properties(chosen), KEY_COLUMNS[config.attribute_type])
    # The payload is written first: the writes below read it several times, and it is part of the record.
    payload = change.replace(PAYLOAD, made)
    properties = payload_properties(payload)

    if config.attribute_type == "1":
        main = persist.insert_object_attributes(log[target], payload, properties)
        name = OBJECT_LINK
        links = change.links(name) or spark.createDataFrame([], OBJECT_LINK_SCHEMA)
        associations = list(config.associations) or [Association(config.qualifier)]
        linked = persist.object_links(links, payload, associations, log["event"])
    else:
        main = persist.fill_event_attributes(log[target], payload, properties)
        name = EVENT_LINK
        links = change.links(name) or spark.createDataFrame([], EVENT_LINK_SCHEMA)
        linked = persist.event_links(links, payload, config.qualifier)

    ledger = persist.tick_ledger(
        _or_empty(log, LEDGER, LEDGER_SCHEMA, spark), config.device_type, config.selected_type
    )
    main_counts, link_counts = main.counts.first(), linked.counts.first()
    if main.cells is None:
        change.add(target, main.added)
    else:
        change.fill(target, main.cells)
    change.add(name, linked.added)
    change.replace(LEDGER, ledger)
    log = change.commit()
    remaining = maps.remaining_count(readings if places is None else places, log["object"], log[LEDGER]).first()["remaining"]
    return Result(
        remaining == 0,
        main_counts["inserted"],
        main_counts["skipped"],
        link_counts["inserted"],
        link_counts["skipped"],
    )
