"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.labels import common_type
from sensorthread.schema import PROPERTY, PROPERTY_VALUE


def stack_properties(df: DataFrame, stacked: list[str], names: Iterable[str]) -> DataFrame:
    """One row per row and stacked column: its name as `property`, its value, of a type that holds all of them, as
    `property_value`. Nulls are values too. Of the other columns the canonical ones stay with each row, but for one
    named like the new column."""
    if not stacked:
        return df
    beside = set(names) - {PROPERTY, *stacked}
    value_type = common_type(df.schema[c].dataType for c in stacked)
    widened = df.withColumns({c: F.col(f"`{c}`").cast(value_type) for c in stacked})
    return widened.unpivot(
        [F.col(f"`{c}`") for c in df.columns if c in beside],
        [F.col(f"`{c}`") for c in stacked],
        PROPERTY,
        PROPERTY_VALUE,
    )


def _first_values(payload: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and property: the least (device_id, property_value) that has a value."""
    first = F.min(
        F.struct(F.col("device_id").isNull(), "device_id", F.col(PROPERTY_VALUE).alias("value"))
    ).alias("first")
    return (
        payload.where(F.col(PROPERTY).isNotNull() & F.col(PROPERTY_VALUE).isNotNull())
        .groupBy(*keys, PROPERTY)
        .agg(first)
        .select(*keys, PROPERTY, F.col("first.value").alias(PROPERTY_VALUE))
    )


def first_object_values(payload: DataFrame) -> DataFrame:
    return _first_values(payload, ["location", "result_time"])


def first_event_values(payload: DataFrame) -> DataFrame:
    return _first_values(payload, ["ocel_event_id", "result_time"])


def payload_properties(payload: DataFrame) -> list[str]:
    """Property names, sorted. They become columns, so there are only as many as a table can have."""
    limit = int(payload.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = payload.where(F.col(PROPERTY).isNotNull()).select(PROPERTY).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct properties cannot become columns")
    return sorted(r[0] for r in rows)


def column_names(properties: list[str], keys: Iterable[str] = ()) -> dict[str, list[str]]:
    """The columns that properties become, each with its properties: names that differ in case alone share the first's
    column. A property named like a key column is an error."""
    taken = {k.lower() for k in keys}
    clash = [p for p in properties if p.lower() in taken]
    if clash:
        raise ValueError(f"properties named like key columns: {', '.join(clash)}")
    columns: dict[str, list[str]] = {}
    first: dict[str, str] = {}
    for p in properties:
        columns.setdefault(first.setdefault(p.lower(), p), []).append(p)
    return columns


def pivot_first(payload: DataFrame, keys: list[str], properties: list[str] | None = None) -> DataFrame:
    """One row per key that has any property, one column per property (see column_names)."""
    if properties is None:
        properties = payload_properties(payload)
    columns = column_names(properties, keys)
    # By places, so that any name will do; the names are given last.
    place = F.lit(None).cast("int")
    for i, spelled in enumerate(columns.values()):
        place = F.when(F.col(PROPERTY).isin(spelled), F.lit(i)).otherwise(place)
    # The struct's first field is null for a missing value, so such a row never wins over a value.
    first = F.min(
        F.when(
            F.col(PROPERTY_VALUE).isNotNull(),
            F.struct(F.col("device_id").isNull(), "device_id", F.col(PROPERTY_VALUE).alias("value")),
        )
    )
    placed = payload.where(F.col(PROPERTY).isNotNull()).withColumn("_place", place)
    wide = placed.groupBy(*keys).pivot("_place", list(range(len(columns)))).agg(first)
    return wide.select(*keys, *[F.col(f"`{i}`.value").alias(c) for i, c in enumerate(columns)])


def pivot_object_payload(payload: DataFrame, properties: list[str] | None = None) -> DataFrame:
    return pivot_first(payload, ["location", "result_time"], properties)


def pivot_event_payload(payload: DataFrame, properties: list[str] | None = None) -> DataFrame:
    return pivot_first(payload, ["ocel_event_id", "result_time"], properties)
