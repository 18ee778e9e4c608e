"""Write a payload into the log: new attribute rows, filled attribute columns, and links to the devices.

Each function returns the rows to add, or the cells to fill, together with its counts; what it computes grows with the
payload. Nothing is written over what it read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorthread.functions.folders import key_folder
from sensorthread.operators.reshape import (
    column_names,
    first_object_values,
    payload_properties,
    pivot_first,
)
from sensorthread.schema import KEY_FOLDER, PROPERTY, PROPERTY_VALUE
from sensorthread.session import written


@dataclass(frozen=True)
class Association:
    """A link qualifier, for the payload of one event type or of all."""

    qualifier: str = ""
    event_type: str = "ALL"


@dataclass(frozen=True)
class Write:
    """The table after a write, a one-row frame (`inserted`, `skipped`), and the rows added or the cells filled."""

    table: DataFrame
    counts: DataFrame
    added: DataFrame | None = None
    cells: DataFrame | None = None


def add_property_columns(table: DataFrame, properties: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Add a double column for each property the table lacks, names compared without case. Also returns which
    column holds which property."""
    names = {c.lower(): c for c in table.columns}
    added: dict[str, str] = {}
    for prop in properties:
        if prop.lower() not in names:
            names[prop.lower()] = prop
            added[prop] = prop
    grown = table.withColumns({p: F.lit(None).cast("double") for p in added})
    return grown, {p: names[p.lower()] for p in properties}


def _quoted(name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_cells(table: DataFrame, cells: list[DataFrame]) -> DataFrame:
    """The table with the values of `cells` (`ocel_id` and columns) where it has none; columns it lacks come last. No two
    of the frames give the same cell, as each was filled where there was nothing."""
    if not cells:
        return table
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cells)
    columns = [c for c in every.columns if c != "ocel_id"]
    places = {c: f"_cell_{i}" for i, c in enumerate(columns)}
    of_row = every.groupBy(F.col("ocel_id")).agg(
        F.lit(True).alias("_filled"), *[F.max(_quoted(c)).alias(place) for c, place in places.items()]
    )
    own = {c: F.coalesce(_quoted(c), places[c]) if c in places else _quoted(c) for c in table.columns}
    new = {c: F.col(places[c]) for c in columns if c not in own}
    return table.join(of_row, "ocel_id", "left").select(*[v.alias(c) for c, v in {**own, **new}.items()])


def _kept(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, DataFrame]:
    """The rows, written, and a one-row frame of sums over them, which the write counts on its way (0 for no rows)."""
    seen = Observation()
    names = {name: F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias(name) for name, value in sums.items()}
    rows = written(df.observe(seen, *names.values()), label)
    counts = seen.get
    spark = df.sparkSession
    return rows, spark.createDataFrame([tuple(counts[n] for n in sums)], ", ".join(f"{n} bigint" for n in sums))


def in_folders_of(existing: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The rows in the folders that candidates may be in, of a table that is dealt to folders by the key; rows that were
    never dealt are kept. The names of the folders, 257 at most, are the only thing collected."""
    if KEY_FOLDER not in existing.columns:
        return existing
    folders = [r.f for r in candidates.select(key_folder(F.col(key)).alias("f")).distinct().collect()]
    return existing.where(F.col(KEY_FOLDER).isNull() | F.col(KEY_FOLDER).isin(folders))


def _marked(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with `_there`: whether the table has their key. A null in the key never matches. Of a table in folders
    only those of the candidates are read, of one with times only their times."""
    candidates = written(candidates, "candidates")
    existing = in_folders_of(existing, candidates, keys[0])
    if "ocel_time" in keys:
        first, last = candidates.agg(F.min("ocel_time"), F.max("ocel_time")).first()
        existing = existing.where(F.col("ocel_time").between(F.lit(first), F.lit(last)))
    there = existing.select(*keys, F.lit(True).alias("_there")).distinct()
    return candidates.join(there, keys, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))


def insert_object_attributes(
    table: DataFrame, payload: DataFrame, properties: list[str] | None = None
) -> Write:
    """One new row per place, time and property, unless the table has that change already."""
    if properties is None:
        properties = payload_properties(payload)
    column_names(properties, ["ocel_id", "ocel_time", "ocel_changed_field"])
    grown, column_of = add_property_columns(table, properties)
    changes = first_object_values(payload).select(
        F.col("location").alias("ocel_id"),
        F.col("result_time").alias("ocel_time"),
        F.col(PROPERTY).alias("ocel_changed_field"),
        PROPERTY_VALUE,
    )
    marked, counts = _kept(
        _marked(changes, table, ["ocel_id", "ocel_time", "ocel_changed_field"]),
        "marked",
        inserted=~F.col("_there"),
        skipped=F.col("_there"),
    )
    columns: dict[str, Column] = {}
    for column in dict.fromkeys(column_of.values()):
        fields = [p for p, c in column_of.items() if c == column]
        value = F.when(F.col("ocel_changed_field").isin(fields), F.col(PROPERTY_VALUE))
        columns[column] = value.cast(grown.schema[column].dataType).alias(column)
    rows = marked.where(~F.col("_there")).select(
        "ocel_id", "ocel_time", "ocel_changed_field", *columns.values()
    )
    return Write(grown.unionByName(rows, allowMissingColumns=True), counts, rows)


def fill_event_attributes(
    table: DataFrame, payload: DataFrame, properties: list[str] | None = None
) -> Write:
    """Set the attributes of the events in the payload where the table has none. An event counts as inserted if
    any cell is filled, else as skipped; payload events the table lacks count as neither."""
    if properties is None:
        properties = payload_properties(payload)
    own = column_names(properties, ["ocel_id", "ocel_time"])
    grown, column_of = add_property_columns(table, properties)
    places = {c: f"_new_{i}" for i, c in enumerate(own)}
    source = pivot_first(payload, ["ocel_event_id"], properties).toDF("ocel_id", *places.values())
    # Only the events of the payload, with the columns it has values for.
    targets = dict.fromkeys(column_of.values())
    joined = grown.select("ocel_id", *[_quoted(c) for c in targets]).join(source, "ocel_id")
    fresh = {
        column_of[c]: F.col(place).cast(grown.schema[column_of[c]].dataType) for c, place in places.items()
    }
    gains = {c: _quoted(c).isNull() & v.isNotNull() for c, v in fresh.items()}
    gained = F.greatest(F.lit(False), F.lit(False), *gains.values())
    each, counts = _kept(
        joined.select("ocel_id", *[F.when(gains[c], fresh[c]).alias(c) for c in targets], gained.alias("_gained")),
        "gains",
        inserted=F.col("_gained"),
        skipped=~F.col("_gained"),
    )
    # An event that the table has twice gives its cells once.
    cells = each.where("_gained").groupBy("ocel_id").agg(*[F.max(_quoted(c)).alias(c) for c in targets])
    return Write(with_cells(table, [cells]), counts, cells=cells)


def object_links(
    links: DataFrame, payload: DataFrame, associations: list[Association], events: DataFrame | None = None
) -> Write:
    """Distinct (object, device, qualifier, time) per association that the link table lacks. An association with
    an event type takes only payload rows of events of that type, which needs the log's `event` table.

    Associations are written one after the other, so a link two of them give is inserted by the first and skipped by
    the second.
    """
    associations = associations or [Association()]
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("at"), F.lit(a.qualifier).alias("q"), F.lit(a.event_type).alias("t"))
            for i, a in enumerate(associations)
        ]
    )
    typed = any(a.event_type != "ALL" for a in associations)
    rows = payload
    if typed:
        types = sorted({a.event_type for a in associations} - {"ALL"})
        of_type = events.where(F.col("ocel_type").isin(types)).select(
            F.col("ocel_id").alias("ocel_event_id"), F.col("ocel_type").alias("_type")
        )
        rows = payload.join(of_type, "ocel_event_id", "left")
    else:
        rows = payload.withColumn("_type", F.lit(None).cast("string"))
    each = (
        rows.select("location", "device_id", "result_time", "_type", F.explode(wanted).alias("a"))
        .where((F.col("a.t") == "ALL") | (F.col("a.t") == F.col("_type")))
        .select(
            F.col("location").alias("ocel_object_id"),
            F.col("device_id").alias("ocel_IoT_object_id"),
            F.col("a.q").alias("ocel_qualifier"),
            F.col("result_time").alias("ocel_time"),
            F.col("a.at").alias("_at"),
        )
    )
    keys = ["ocel_object_id", "ocel_IoT_object_id", "ocel_qualifier", "ocel_time"]
    # How many associations give a link; a link without nulls is new to the first of them only.
    grouped = each.groupBy(*keys).agg(F.count_distinct("_at").alias("_times"))
    complete = ~F.greatest(*[F.col(k).isNull() for k in keys])
    skipped = (
        F.when(F.col("_there"), F.col("_times"))
        .when(complete, F.col("_times") - 1)
        .otherwise(F.lit(0))
    )
    marked, counts = _kept(
        _marked(grouped, links, keys), "marked", inserted=F.col("_times") - skipped, skipped=skipped
    )
    copies = F.when(complete, F.lit(1)).otherwise(F.col("_times"))
    rows = (
        marked.where(~F.col("_there"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
        .select(*keys)
    )
    return Write(links.drop(KEY_FOLDER).unionByName(rows), counts, rows)


def event_links(links: DataFrame, payload: DataFrame, qualifier: str = "") -> Write:
    """Distinct (event, device, qualifier) that the link table lacks."""
    keys = ["ocel_event_id", "ocel_IoT_object_id", "ocel_qualifier"]
    candidates = (
        payload.where(F.col("ocel_event_id").isNotNull())
        .select(
            "ocel_event_id",
            F.col("device_id").alias("ocel_IoT_object_id"),
            F.lit(qualifier).alias("ocel_qualifier"),
        )
        .distinct()
    )
    marked, counts = _kept(
        _marked(candidates, links, keys), "marked", inserted=~F.col("_there"), skipped=F.col("_there")
    )
    rows = marked.where(~F.col("_there")).select(*keys)
    return Write(links.drop(KEY_FOLDER).unionByName(rows), counts, rows)


def tick_ledger(ledger: DataFrame, device_type: str, object_type: str) -> DataFrame:
    """The ledger with one row for the pair, timed now."""
    spark = ledger.sparkSession
    pair = spark.createDataFrame([(device_type, object_type)], "device_type string, ocel_type string")
    row = pair.withColumn("timestamp", F.localtimestamp())
    kept = ledger.join(pair, ["device_type", "ocel_type"], "left_anti").select(*ledger.columns)
    return kept.unionByName(row)
