"""Numbers about an object-centric event log, and its directly-follows graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.operators.log import EventLog
from sensorthread.operators.ordered import HOT_ROWS, crowding, hot_keys, pieces, with_successor
from sensorthread.session import written


def overview(log: EventLog) -> DataFrame:
    """One row: events, objects, activities, object types and event-object relations."""
    kinds = {"event": F.col("ocel_type"), "object": F.col("ocel_type"), "event_object": F.lit(None).cast("string")}
    rows = reduce(
        DataFrame.unionByName,
        [log[kind].select(F.lit(kind).alias("kind"), t.alias("ocel_type")) for kind, t in kinds.items()],
    )
    sizes = rows.groupBy("kind", "ocel_type").agg(F.count(F.lit(1)).alias("n"))

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    def types(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("ocel_type")))

    return sizes.agg(
        total("event").alias("events"),
        total("object").alias("objects"),
        types("event").alias("activities"),
        types("object").alias("object_types"),
        total("event_object").alias("relationships"),
    )


def events_per_activity(log: EventLog) -> DataFrame:
    return log["event"].groupBy(F.col("ocel_type").alias("activity")).agg(F.count(F.lit(1)).alias("events"))


def objects_per_type(log: EventLog) -> DataFrame:
    return log["object"].groupBy(F.col("ocel_type").alias("object_type")).agg(F.count(F.lit(1)).alias("objects"))


def activities_per_object_type(log: EventLog) -> DataFrame:
    """Relations shrink to distinct (object, activity) before they meet the objects."""
    activities = log["event"].select(F.col("ocel_id").alias("ocel_event_id"), F.col("ocel_type").alias("activity"))
    objects = log["object"].select(F.col("ocel_id").alias("ocel_object_id"), F.col("ocel_type").alias("object_type"))
    return (
        log["event_object"]
        .select("ocel_event_id", "ocel_object_id")
        .join(activities, "ocel_event_id")
        .select("ocel_object_id", "activity")
        .distinct()
        .join(objects, "ocel_object_id")
        .select("object_type", "activity")
        .distinct()
        .groupBy("object_type")
        .agg(F.count("activity").alias("activities"))
    )


def events_over_time(log: EventLog, unit: str = "day") -> DataFrame:
    """Events per activity and period."""
    return (
        log.event_times()
        .groupBy(F.col("ocel_type").alias("activity"), F.date_trunc(unit, "ocel_time").cast("timestamp_ntz").alias("period"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


# Bits by which an event knows its objects, each object one of them.
BITS = 32


def _numbered(log: EventLog, parts: int | None = None) -> DataFrame:
    """One row per relation whose event has a time: `place`, `time`, `event`, `activity`, `others`, where `event` is a number
    that orders events as their ids do and is shorter than these, and `others` has the bits of the other places of the
    event. All bits are set where an id stands for several events.

    Events and relations are dealt out by ranges of ids together, so that both meet in order within a partition. Numbers
    are of one run of the plan: what reads them twice must write them first.
    """
    events = log.event_times().select(
        F.col("ocel_id").alias("id"),
        F.col("ocel_time").alias("time"),
        F.col("ocel_type").alias("activity"),
    )
    # Relations of an event that lie together stay together on the way, which packs well.
    relations = log["event_object"].select(F.col("ocel_event_id").alias("id"), F.col("ocel_object_id").alias("place"))
    together = events.unionByName(relations, allowMissingColumns=True).where(F.col("id").isNotNull())
    bit = F.when(F.col("activity").isNull(), F.expr(f"shiftleft(1, CAST(pmod(xxhash64(place), {BITS}) AS INT))"))
    dealt = (
        together.repartitionByRange(*_number(parts), "id")
        .withColumn("_bit", bit)
        .sortWithinPartitions("id", "_bit")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    event, alike = Window.partitionBy("id"), Window.partitionBy("id", "_bit")
    known = dealt.select(
        "place",
        "_bit",
        F.min("_row").over(event).alias("event"),
        F.collect_list(F.when(F.col("_bit").isNull(), F.struct("time", "activity"))).over(event).alias("_events"),
        F.bit_or("_bit").over(event).alias("_all"),
        (F.min("place").over(alike) != F.max("place").over(alike)).alias("_shared"),
    )
    apart = F.col("_all").bitwiseAND(F.bitwise_not("_bit"))
    others = F.when(F.size("_events") > 1, F.lit(-1)).when(F.col("_shared"), F.col("_all")).otherwise(apart)
    return known.where(F.col("_bit").isNotNull()).select("place", "event", others.alias("others"), F.inline("_events"))


def _number(parts: int | None) -> list[int]:
    return [] if parts is None else [parts]


def _steps(log: EventLog, parts: int | None = None) -> DataFrame:
    """One row per relation: object_type, object, time, event (its number), activity, others. A relation that stands twice in
    the log (under two qualifiers) gives equal rows. `parts` is the number of partitions, if the session's will not do."""
    objects = log["object"].select(F.col("ocel_id").alias("place"), F.col("ocel_type").alias("object_type"))
    numbered = _numbered(log, parts)
    return (
        (numbered if parts is None else numbered.repartition(parts, "place"))
        .join(objects, "place")
        .select("object_type", F.col("place").alias("object"), "time", "event", "activity", "others")
    )


def directly_follows(log: EventLog, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per object type, how often activity b comes right after activity a in the life of an object: occurrences,
    objects, and pairs of events. Events of an object are ordered by time, then by id."""
    # An object has no more steps than relations, so hot objects show without the joins.
    relations = log["event_object"].select(F.col("ocel_object_id").alias("object"))
    rows, most = crowding(relations, ["object"])
    hot = hot_keys(relations, ["object"], hot_rows) if most > hot_rows else None
    if hot is None:
        steps = _steps(log, pieces(relations.sparkSession, rows))
    else:
        # Hot objects and others are read apart.
        steps = written(_steps(log), "steps")
    carried = ["event", "activity", "others"]
    steps = with_successor(steps, ["object"], ["time", "event"], carried, hot).where(
        # Equal rows are neighbours; a step from an event to itself is none.
        F.col("next_event") != F.col("event")
    )
    edge = ["object_type", "activity", "next_activity"]
    # One step of each edge stands for the object, so that all three counts come from one grouping by pairs of events.
    own = Window.partitionBy("object", *edge).orderBy("event")
    marked = steps.withColumn("_first", (F.row_number().over(own) == 1).cast("long"))
    # A pair of events can be met again at another object only if both events have it, and then their bits meet. All other
    # pairs are counted where they are, as the pair of nulls.
    again = F.col("others").bitwiseAND(F.col("next_others")) != 0
    met = [F.when(again, F.col(c)).alias(c) for c in ("event", "next_event")]
    pairs = marked.groupBy(*edge, *met).agg(F.count(F.lit(1)).alias("n"), F.sum("_first").alias("firsts"))
    distinct = F.when(F.col("event").isNull(), F.col("n")).otherwise(1)
    return pairs.groupBy(*edge).agg(
        F.sum("n").alias("occurrences"), F.sum("firsts").alias("objects"), F.sum(distinct).alias("event_pairs")
    )


def start_and_end_activities(log: EventLog) -> DataFrame:
    """Per object type and activity, the number of objects whose life starts and ends with it."""
    moment = F.struct("time", "event", "activity")
    ends = _steps(log).groupBy("object_type", "object").agg(F.min(moment).alias("first"), F.max(moment).alias("last"))
    sides = F.array(
        F.struct(F.col("first.activity").alias("activity"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("last.activity").alias("activity"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )
    return (
        ends.select("object_type", F.inline(sides))
        .groupBy("object_type", "activity")
        .agg(F.sum("s").alias("starts"), F.sum("e").alias("ends"))
    )
