"""An object-centric event log as a set of named DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.clock import naive


class EventLog(dict[str, DataFrame]):
    """Tables by name: `event`, `object`, `event_object`, the two type tables and one table per type."""

    def type_map(self, kind: str) -> dict[str, str]:
        """Type to table suffix, from `event_map_type` or `object_map_type`: one row per table of the log."""
        table = self[f"{kind}_map_type"].select("ocel_type", "ocel_type_map").distinct()
        return {r.ocel_type: r.ocel_type_map for r in table.collect() if r.ocel_type_map is not None}

    def table_name(self, kind: str, ocel_type: str) -> str:
        suffix = self.type_map(kind).get(ocel_type)
        if suffix is None:
            raise ValueError(f"no {kind} table for type {ocel_type!r}")
        return f"{kind}_{suffix}"

    def event_times(self, types: list[str] | None = None) -> DataFrame:
        """`ocel_id`, `ocel_type` and `ocel_time` of the events of the given types (all types by default). The
        table of a type holds the events of that type, so the `event` table is not needed."""
        names = self.type_map("event")
        wanted = sorted(names) if types is None else [t for t in sorted(set(types)) if t in names]
        if not wanted:
            raise ValueError(f"no event tables for types {types}")
        if len({names[t] for t in wanted}) < len(wanted):
            raise ValueError("two event types share a table")
        return reduce(
            DataFrame.unionByName,
            [
                self[f"event_{names[t]}"].select(
                    "ocel_id", F.lit(t).alias("ocel_type"), naive("ocel_time").alias("ocel_time")
                )
                for t in wanted
            ],
        )

    def related_events(self, types: list[str] | None = None) -> DataFrame:
        """One row per event-object relation: `ocel_event_id`, `ocel_type`, `place` (the object), `event_time`."""
        times = self.event_times(types).select(
            F.col("ocel_id").alias("ocel_event_id"), "ocel_type", F.col("ocel_time").alias("event_time")
        )
        relations = self["event_object"].select("ocel_event_id", F.col("ocel_object_id").alias("place"))
        return relations.join(times, "ocel_event_id")
