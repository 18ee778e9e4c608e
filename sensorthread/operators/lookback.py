"""What was read in the last n minutes before a moment, per key.

Two time-ordered tables meet on `at - lookback <= reading time <= at`, both ends included. Joining them pairwise
would emit every reading once per moment that sees it, so the work is done on mergeable partial states instead
(counts, sums, extremes, latest time).

Time is cut into spans as long as the lookback. A window then is the end of one span and the beginning of the next,
and both are running aggregates: over the rows of the span up to a time, and from a time on. Rows are first reduced
to one per key and time, on the map side.

A span that still has too many rows for one task is cut again, into about sqrt(span) slots. Its part of a window is
then the rest of the slot where it begins and all later slots, or all earlier slots and the part of the slot where it
ends. A slot holds at most one row per microsecond and a span one row per slot: at a lookback of one hour neither can
pass 60,000 rows, however the data is skewed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.functions.clock import MINUTE
from sensorthread.operators.ordered import HOT_ROWS, crowding, hot_keys, split_hot, with_successor
from sensorthread.session import written


@dataclass(frozen=True)
class Measure:
    """A partial state: its value for one reading, and the aggregate that merges two states."""

    per_row: Column
    merge: Callable[[Column | str], Column]


# Stretches are filed under slots of several widths, each this many times narrower than the one before.
SLOT_STEP = 4
SLOT_WIDTHS = 13

# Times that a stretch meets, on average, from which slots a step narrower pay: fewer are compared in vain then, at the price
# of more rows per stretch.
MANY_MET = 2_000

# Readings that a task takes, about, where all work on a key is done by one, and readings such a key may have at most.
READINGS_PER_TASK = 150_000
READINGS_OF_KEY = 500_000

# Pairs of rows that a task of a join makes, about, and the tasks there are at most.
PAIRS_PER_TASK = 20_000_000
MOST_TASKS = 20_000

# Rows of the right side that a row of the left one meets at once, about: their pairs are held in memory together. Up to 4,096
# rows are also read again without a sorter.
MET_AT_ONCE = 3_500

# Whether a window holds a reading at all is a state like the others.
_READ = "_read"


def _merge_columns(merge: Callable, columns: list[Column]) -> Column:
    if merge is F.max:
        return F.greatest(*columns)
    if merge is F.min:
        return F.least(*columns)
    known = reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])
    return F.when(known, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns]))


def lookback_states(
    readings: DataFrame,
    probes: DataFrame,
    lookback: int,
    measures: dict[str, Measure],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Merged states per probe.

    `readings` has `key`, `us` (time in microseconds) and what the measures use; `probes` has `key` and `us`.
    Returns `key`, `us` and one column per measure, for the probes that see at least one reading.
    """
    span = int(lookback) * MINUTE
    if span < 0:
        raise ValueError("a lookback cannot be negative")
    merges = {name: m.merge for name, m in measures.items()}
    states = readings.select("key", "us", *[m.per_row.alias(n) for n, m in measures.items()])
    if span == 0:
        seen = states.groupBy("key", "us").agg(*_merged(merges))
        return probes.select("key", "us").distinct().join(seen, ["key", "us"])

    merges = {_READ: F.max, **merges}
    yes, no = F.lit(True), F.lit(False)
    ends = F.struct(F.col("us"), yes.alias("_ends"), no.alias("_starts"))
    starts = F.struct((F.col("us") - span).alias("us"), no.alias("_ends"), yes.alias("_starts"))
    edges = probes.select("key", F.inline(F.array(ends, starts)))
    # Read below by the check for hot spans and by both ways through, so it is computed once and kept.
    moments = written(
        states.withColumns({_READ: yes, "_ends": no, "_starts": no})
        .unionByName(edges, allowMissingColumns=True)
        .groupBy("key", "us")
        .agg(*_merged(merges), F.max("_ends").alias("_ends"), F.max("_starts").alias("_starts"))
        .withColumn("_span", F.expr(f"(us - pmod(us, {span})) div {span}")),
        "moments",
    )
    place = ["key", "_span"]
    calm, busy = split_hot(moments, place, hot_keys(moments, place, hot_rows))
    pieces = _running(calm, place, merges)
    if busy is not None:
        pieces = pieces.unionByName(_running_in_slots(busy, span, merges))
    return _put_together(pieces, span, merges)


def _states_at_changes(readings: DataFrame, span: int, measures: dict[str, Measure], rows: int) -> DataFrame:
    """`lookback_states` at the times when a reading enters a window or has left it, for keys that each fit into a task: rows
    are dealt out by key, and all else happens where they are."""
    merges = {_READ: F.max, **{name: m.merge for name, m in measures.items()}}
    states = readings.select("key", "us", *[m.per_row.alias(n) for n, m in measures.items()])
    parts = [] if rows <= READINGS_PER_TASK * 8 else [-(-rows // READINGS_PER_TASK)]
    kinds = dict(states.dtypes)

    def row(shift: int, read: bool, ends: bool) -> Column:
        values = [F.col(n) if read else F.lit(None).cast(kinds[n]).alias(n) for n in measures]
        flags = [F.lit(True if read else None).cast("boolean").alias(_READ), F.lit(ends).alias("_ends"), F.lit(not ends).alias("_starts")]
        return F.struct((F.col("us") + shift).alias("us"), *flags, *values)

    # Two windows: the first that sees the reading, and the first that does not any more.
    edges = F.array(row(0, True, True), row(-span, False, False), row(span + 1, False, True), row(1, False, False))
    moments = (
        states.repartition(*parts, "key")
        .select("key", F.inline(edges))
        .groupBy("key", "us")
        .agg(*_merged(merges), F.max("_ends").alias("_ends"), F.max("_starts").alias("_starts"))
        .withColumn("_span", F.expr(f"(us - pmod(us, {span})) div {span}"))
    )
    return _put_together(_running(moments, ["key", "_span"], merges), span, merges)


def _put_together(pieces: DataFrame, span: int, merges: dict[str, Callable]) -> DataFrame:
    """The states of windows, from those of the two spans that each lies in."""

    def side(flag: str, shift: int, suffix: str) -> Column:
        values = [F.col(f"{n}_{suffix}").alias(n) for n in merges]
        return F.when(F.col(flag), F.struct((F.col("us") + shift).alias("us"), *values))

    # A time can end one window and begin another, so a row gives one or two pieces.
    sides = F.array_compact(F.array(side("_ends", 0, "upto"), side("_starts", span, "onward")))
    return (
        pieces.select("key", F.inline(sides))
        .where(_READ)
        .groupBy("key", "us")
        .agg(*_merged({n: m for n, m in merges.items() if n != _READ}))
    )


def lookback_stretches(
    readings: DataFrame, lookback: int, measures: dict[str, Measure], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Merged states of all windows that see a reading, whenever they end.

    A state changes only when a reading enters the window or leaves it, so a key has at most twice as many stretches
    with one state as it has times. Returns `key`, `since` and `until` (the window ends at or after the one and before the other)
    and one column per measure.
    """
    span = int(lookback) * MINUTE
    if span <= 0:
        rows = readings.select("key", F.col("us").alias("since"), *[m.per_row.alias(n) for n, m in measures.items()])
        states = rows.groupBy("key", "since").agg(*_merged({n: m.merge for n, m in measures.items()}))
        return states.withColumn("until", F.col("since") + 1)
    bounded = {**measures, "_first": Measure(F.col("us"), F.min)}
    # A key has no more than two states a reading, so hot keys show without the states.
    rows, most = crowding(readings, ["key"])
    if most <= min(hot_rows // 2, READINGS_OF_KEY):
        hot = None
        states = _states_at_changes(readings, span, bounded, rows)
    else:
        hot = hot_keys(readings, ["key"], max(hot_rows // 2, 1))
        changes = readings.select("key", F.explode(F.array(F.col("us"), F.col("us") + (span + 1))).alias("us"))
        states = lookback_states(readings, changes, lookback, bounded, hot_rows)
    ended = F.least(F.col("next_us"), F.col("_first") + (span + 1))
    return with_successor(states, ["key"], ["us"], ["us"], hot).select(
        "key", F.col("us").alias("since"), ended.alias("until"), *measures
    )


def within_stretches(stretches: DataFrame, times: DataFrame, lookback: int) -> DataFrame:
    """Each row of `times` (with `us`) with each stretch that it falls in.

    Stretches are filed under slots that are at least as wide as they are long, but not much wider, and a time meets
    those of its slot of each width. So few stretches of a key are compared per one that is met, be they long or short.
    Where a stretch meets many times, slots are a step narrower.
    """
    span = int(lookback) * MINUTE
    if span <= 0:
        return join_spread(stretches.withColumnRenamed("since", "us").drop("until"), times, ["us"])

    def slot(us: str) -> Column:
        return F.expr(f"({us} - pmod({us}, _width)) div _width")

    widths = [max((span + 1) // SLOT_STEP**k, 1) for k in range(SLOT_WIDTHS)]
    length = F.col("until") - F.col("since")
    width = reduce(lambda wide, w: F.when(length <= w, F.lit(w).cast("long")).otherwise(wide), widths[1:], F.lit(widths[0]).cast("long"))
    # Read twice below: for the widths that there are, and for the join.
    filed = written(stretches.withColumn("_width", width), "stretches")
    sizes = filed.groupBy("_width").agg(F.count(F.lit(1)).alias("n"), F.sum(length.cast("double")).alias("length")).collect()
    used = sorted(r["_width"] for r in sizes)
    if _met(times, sum(r["length"] or 0.0 for r in sizes)) > MANY_MET * sum(r["n"] for r in sizes):
        used = sorted({max(w // SLOT_STEP, 1) for w in used})
        filed = filed.withColumn("_width", F.greatest(F.expr(f"_width div {SLOT_STEP}"), F.lit(1).cast("long")))
    placed = filed.withColumn("_slot", F.explode(F.sequence(slot("since"), slot("(until - 1)"))))
    each = F.array(*[F.lit(w) for w in used]).cast("array<bigint>")
    asking = times.withColumn("_width", F.explode(each)).withColumn("_slot", slot("us"))
    met = join_spread(placed, asking, ["_width", "_slot"]).where((F.col("since") <= F.col("us")) & (F.col("us") < F.col("until")))
    return met.drop("_width", "_slot", "since", "until")


def _met(times: DataFrame, length: float) -> float:
    """About how many times fall into stretches of that length in all, if they are spread evenly."""
    n, first, last = times.agg(F.count("us"), F.min("us"), F.max("us")).first()
    return n * length / (last - first + 1) if n else 0.0


def join_spread(
    left: DataFrame, right: DataFrame, on: list[str], pairs_per_task: int | None = None, met_at_once: int | None = None
) -> DataFrame:
    """The inner join by `on`, where far more rows come out than go in.

    Adaptive execution merges partitions by the bytes that go in, which would leave all the rows to a few tasks. So the
    tasks are laid out by the pairs they make. Where one key has many, they are cut into a grid: the right rows are dealt out
    to columns of `met_at_once`, the left rows to as many lines as keep a field below the limit, and a row is repeated
    for each field of its line or column.
    """
    limit, most = pairs_per_task or PAIRS_PER_TASK, met_at_once or MET_AT_ONCE
    ours, theirs = (df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_left"), (right, "_right")))
    pairs = written(ours.join(theirs, on).withColumn("_pairs", F.col("_left") * F.col("_right")), "pairs")
    total = pairs.agg(F.sum(F.col("_pairs").cast("double"))).first()[0] or 0.0
    tasks = min(max(int(total // limit) + 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    columns = F.ceil(F.col("_right") / most)
    lines = F.ceil(F.col("_left") * F.least("_right", F.lit(most)) / limit)
    # At most total / limit keys, and one per `most` rows of the right side.
    hot = pairs.select(*on, lines.cast("int").alias("_lines"), columns.cast("int").alias("_columns")).where("_lines > 1 OR _columns > 1")
    if not hot.isEmpty():
        left, right = _dealt(left, on, hot, "_lines", "_columns"), _dealt(right, on, hot, "_columns", "_lines")
        on = [*on, "_line", "_column"]
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).drop("_line", "_column")


def _dealt(df: DataFrame, on: list[str], hot: DataFrame, dealt: str, repeated: str) -> DataFrame:
    """The rows with `_line` and `_column`: of hot keys dealt out over the one and repeated for all of the other, 0 for the rest."""
    one = F.pmod(F.xxhash64(*df.columns), F.coalesce(dealt, F.lit(1))).cast("int").alias(dealt.rstrip("s"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce(repeated, F.lit(1)) - 1)).alias(repeated.rstrip("s"))
    return df.join(F.broadcast(hot), on, "left").select(*df.columns, one, each)


def _merged(merges: dict[str, Callable]) -> list[Column]:
    return [merge(name).alias(name) for name, merge in merges.items()]


def _running(moments: DataFrame, place: list[str], merges: dict[str, Callable]) -> DataFrame:
    """The rows where a window begins or ends, with the states of their place up to their time and from it on."""
    group = Window.partitionBy(*place)
    upto = group.orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    onward = group.orderBy(F.desc("us")).rowsBetween(Window.unboundedPreceding, 0)
    return moments.select(
        *place,
        "us",
        "_ends",
        "_starts",
        *[merge(n).over(upto).alias(f"{n}_upto") for n, merge in merges.items()],
        *[merge(n).over(onward).alias(f"{n}_onward") for n, merge in merges.items()],
    ).where("_ends OR _starts")


def _running_in_slots(moments: DataFrame, span: int, merges: dict[str, Callable]) -> DataFrame:
    """The same for spans too large for one task, by way of their slots."""
    slot = max(isqrt(span - 1) + 1, 1)
    place = ["key", "_span", "_slot"]
    slotted = moments.withColumn("_slot", F.expr(f"(us - _span * {span}) div {slot}"))
    totals = slotted.groupBy(*place).agg(*_merged(merges), F.max(F.col("_ends") | F.col("_starts")).alias("_edge"))
    group = Window.partitionBy("key", "_span")
    earlier = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    around = totals.select(
        *place,
        "_edge",
        *[merge(n).over(earlier).alias(f"{n}_earlier") for n, merge in merges.items()],
        *[merge(n).over(later).alias(f"{n}_later") for n, merge in merges.items()],
    ).where("_edge")
    joined = _running(slotted, place, merges).join(around, place)

    def both(name: str, near: str, far: str) -> Column:
        columns = [F.col(f"{name}_{near}"), F.col(f"{name}_{far}")]
        return _merge_columns(merges[name], columns).alias(f"{name}_{near}")

    return joined.select(
        "key",
        "_span",
        "us",
        "_ends",
        "_starts",
        *[both(n, "upto", "earlier") for n in merges],
        *[both(n, "onward", "later") for n in merges],
    )
