"""Exact medians of what was read in the last n minutes before a moment.

A median has no mergeable state of fixed size. The readings of two neighbouring spans of a key are few as a rule: they
become one array in value order, and each window that ends in the second span takes the middle of the part it sees.

Spans with more readings go to a task each, as columns of numbers, where all windows search for their middle at once: the
readings, in the order of time, are parted by one bit of their place in the value order after the other, and a count of
the zeros up to each reading tells every window which half its middle is in. That is as many steps as the places have
bits, over arrays, and no shuffle.

Spans too large even for that are searched by rank in the same way across tasks, a digit at a time: how many readings
of a window have each next digit is a count over the last n minutes, which `lookback_states` gives for groups of any
size. No way makes a row per pair of reading and window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.functions.clock import MINUTE
from sensorthread.operators.lookback import Measure, lookback_states
from sensorthread.operators.ordered import ordered_chunks, packed
from sensorthread.session import freeze, written

# Rows of two neighbouring spans of one key that may become an array.
ARRAY_ROWS = 2_000

# Rows of two neighbouring spans that one task may hold: some 100 bytes each, at the most of the search.
TASK_ROWS = 4_000_000

# A search looks at this many parts of its range in each round. More parts save rounds but add rows: with 16, a million
# readings take five rounds and at most 80 rows per window.
_DIGIT = 16


def window_medians(
    readings: DataFrame,
    probes: DataFrame,
    lookback: int,
    array_rows: int = ARRAY_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """`value` per probe (`key`, `us`) that sees a reading: the median of `v`, null if all it sees are null."""
    reach = lookback * MINUTE
    width = max(reach, 1)
    span = F.expr(f"(us - pmod(us, {width})) div {width}")
    reach_into = F.array(span, span + 1) if reach else F.array(span)
    rows = written(
        readings.select("key", "us", "v", F.explode(reach_into).alias("span"), F.lit(False).alias("probe")).unionByName(
            probes.distinct().select(
                "key", "us", F.lit(None).cast("double").alias("v"), span.alias("span"), F.lit(True).alias("probe")
            )
        ),
        "windows",
    )
    place = ["key", "span"]
    sizes = rows.groupBy(packed(place).alias("_place")).agg(F.count(F.lit(1)).alias("_rows"))
    # Numbered, so that the rows of a large place carry a number in place of its key.
    large = freeze(sizes.where(F.col("_rows") > array_rows).withColumn("_at", F.monotonically_increasing_id()))
    if large.isEmpty():
        return _from_arrays(rows, place, reach)
    keyed = rows.withColumn("_place", packed(place))
    calm = keyed.join(large.select("_place"), "_place", "left_anti").drop("_place")
    result = _from_arrays(calm, place, reach)
    held, giant = large.where(F.col("_rows") <= task_rows), large.where(F.col("_rows") > task_rows)
    if not held.isEmpty():
        result = result.unionByName(_in_tasks(keyed, held.select("_place", "_at"), reach))
    if not giant.isEmpty():
        most = keyed.join(giant.select("_place"), "_place", "left_semi").drop("_place")
        result = result.unionByName(_by_rank(most, lookback))
    return result


def _in_tasks(keyed: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    found = (
        keyed.join(places, "_place")
        .select("_at", "us", "v", "probe")
        .groupBy("_at")
        .applyInArrow(_medians_of_place(reach), "_at long, us long, value double")
    )
    return found.join(places, "_at").select(F.col("_place.key").alias("key"), "us", "value")


def _medians_of_place(reach: int):
    """The function of a place, which loads no more of this package where tasks run than these two functions."""

    def middles(times: np.ndarray, values: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per moment how many values it sees, and their median (nan if none); `times` ascend."""
        low, high = np.searchsorted(times, moments - reach, "left"), np.searchsorted(times, moments, "right")
        seen = high - low
        known, rank = np.unique(values, return_inverse=True)  # Nan is the greatest, as in Spark.
        # Each window asks twice, for the lower and the upper of its middle places.
        some = np.flatnonzero(seen)
        lo, hi = np.tile(low[some], 2), np.tile(high[some], 2)
        need = np.concatenate([(seen[some] - 1) // 2, seen[some] // 2])
        found = np.zeros(len(need), np.int64)
        for bit in range(max(len(known) - 1, 0).bit_length() - 1, -1, -1):
            one = (rank >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            below = zeros[hi] - zeros[lo]
            up = need >= below
            need = np.where(up, need - below, need)
            found |= up.astype(np.int64) << bit
            lo = np.where(up, zeros[-1] + lo - zeros[lo], zeros[lo])
            hi = np.where(up, zeros[-1] + hi - zeros[hi], zeros[hi])
            rank = np.concatenate([rank[~one], rank[one]])
        halves = known[found] / 2 if len(known) else np.empty(0)
        medians = np.full(len(moments), np.nan)
        medians[some] = halves[: len(some)] + halves[len(some) :]
        return seen, medians

    def run(group: pa.Table) -> pa.Table:
        probe = group["probe"].to_numpy(zero_copy_only=False)
        us = group["us"].to_numpy(zero_copy_only=False)
        known = ~probe & group["v"].is_valid().to_numpy(zero_copy_only=False)
        v = group["v"].to_numpy(zero_copy_only=False)
        moments, times = us[probe], np.sort(us[~probe])
        order = np.argsort(us[known], kind="stable")
        seen, medians = middles(us[known][order], v[known][order], moments)
        any_ = np.searchsorted(times, moments, "right") > np.searchsorted(times, moments - reach, "left")
        return pa.table(
            {
                "_at": pa.array(np.full(int(any_.sum()), group["_at"][0].as_py()), pa.int64()),
                "us": pa.array(moments[any_], pa.int64()),
                "value": pa.array(medians[any_], pa.float64(), mask=(seen == 0)[any_], from_pandas=False),
            }
        )

    return run


def _from_arrays(rows: DataFrame, place: list[str], reach: int) -> DataFrame:
    reading, us = ~F.col("probe"), F.col("us")
    groups = rows.groupBy(*place).agg(
        F.collect_list(F.when(F.col("probe"), us)).alias("moments"),
        F.collect_list(F.when(reading, us)).alias("times"),
        F.array_sort(F.collect_list(F.when(reading & F.col("v").isNotNull(), F.struct("v", "us")))).alias("known"),
    )

    def sees(at: Column, moment: Column) -> Column:
        return (at >= moment - reach) & (at <= moment)

    def middle(values: Column) -> Column:
        n = F.size(values)
        low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
        return F.when(n > 0, low["v"] / 2 + high["v"] / 2)

    def window(moment: Column) -> Column:
        values = F.filter("known", lambda r: sees(r["us"], moment))
        # Through an array of one, so that the filter runs once however often its result is named.
        value = F.get(F.transform(F.array(values), middle), F.lit(0))
        return F.when(
            F.exists("times", lambda at: sees(at, moment)), F.struct(moment.alias("us"), value.alias("value"))
        )

    windows = F.array_compact(F.transform("moments", window))
    return groups.select("key", F.inline(windows))


def _by_rank(rows: DataFrame, lookback: int) -> DataFrame:
    grouped = rows.withColumn("key", F.struct("key", "span"))
    probes = grouped.where("probe").select("key", "us")
    readings = grouped.where("NOT probe").select("key", "us", "v")
    ranked = _ranked(readings.where("v IS NOT NULL"))
    highest = ranked.agg(F.max("rank")).first()[0]

    one = Measure(F.lit(1).cast("long"), F.sum)
    known = Measure(F.when(F.col("v").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"), F.sum)
    sizes = written(lookback_states(readings, probes, lookback, {"n": known}), "sizes")
    # The two middle places of each window, the same one if the number of values is odd.
    searches = (
        sizes.where("n > 0")
        .select(
            "key",
            "us",
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.expr("(n - 1) div 2").alias("need")),
                    F.struct(F.lit(1).alias("side"), F.expr("n div 2").alias("need")),
                )
            ),
        )
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    level = 0
    while highest is not None and _DIGIT ** (level + 1) <= highest:
        level += 1
    for size in [_DIGIT**i for i in range(level, -1, -1)] if highest is not None else []:
        searches = written(_next_digit(ranked, searches, size, lookback, one), "searches")
    middles = (
        searches.join(ranked.select("key", F.col("rank").alias("prefix"), "v"), ["key", "prefix"])
        .groupBy("key", "us")
        .agg(F.sum(F.col("v") / 2).alias("value"))
    )
    return sizes.join(middles, ["key", "us"], "left").select(F.col("key.key"), "us", "value")


def _ranked(readings: DataFrame) -> DataFrame:
    """Readings with their place in the value order of their key."""
    chunks = ordered_chunks(readings, ["key", "v", "us"])
    before = Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.groupBy("key", "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("key", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    in_chunk = Window.partitionBy("key", "_chunk").orderBy("v", "us")
    ranked = chunks.join(starts, ["key", "_chunk"]).withColumn(
        "rank", F.col("_start") + F.row_number().over(in_chunk) - 1
    )
    return written(ranked.select("key", "us", "v", "rank"), "ranked")


def _next_digit(
    ranked: DataFrame, searches: DataFrame, size: int, lookback: int, one: Measure
) -> DataFrame:
    """Each search moved into the sub-range of `size` ranks that holds the place it needs."""
    part = F.expr(f"rank div {size}")
    parts = ranked.select("key", part.alias("part")).distinct()
    # At the top there is one range; below, the parts of the range a search is in.
    parent = F.expr(f"part div {_DIGIT}")
    options = searches.join(parts.withColumn("prefix", parent), ["key", "prefix"])
    counted = lookback_states(
        ranked.select(F.struct("key", part.alias("part")).alias("key"), "us"),
        options.select(F.struct("key", "part").alias("key"), "us").distinct(),
        lookback,
        {"n": one},
    ).select(F.col("key.key").alias("key"), F.col("key.part").alias("part"), "us", "n")
    running = (
        Window.partitionBy("key", "us", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        options.join(counted, ["key", "part", "us"])
        .withColumn("upto", F.sum("n").over(running))
        .where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        .select(
            "key", "us", "side", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), F.col("part").alias("prefix")
        )
    )
