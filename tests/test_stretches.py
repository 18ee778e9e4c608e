"""Windows of all events over all keys, by stretches of time with one state."""

import random

import pytest
from pyspark.sql import functions as F

from sensorthread.functions.clock import MINUTE
from sensorthread.operators import lookback as lookback_module
from sensorthread.operators import scenarios
from sensorthread.operators.lookback import Measure, join_spread, lookback_stretches, within_stretches

from .test_scenarios import READINGS, at, make_log


@pytest.mark.parametrize("lookback, unit", [(0, 1000), (1, 1), (7, 20_000_000), (60, 1000)])
@pytest.mark.parametrize("hot_rows", [20, 10**9])
def test_stretches_against_brute_force(spark, lookback, unit, hot_rows):
    rng = random.Random(lookback + unit)
    reach = lookback * MINUTE
    horizon = max(4 * reach // unit, 50)
    readings = [
        ("hot" if i % 3 == 0 else f"k{i % 40}", rng.randrange(-horizon, horizon) * unit, rng.choice([None, 1.0, 2.0, 5.5]))
        for i in range(300)
    ]
    times = [rng.randrange(-horizon, horizon) * unit for _ in range(60)]
    # Times on the very ends of windows, and twice the same.
    times += [us for _, us, _ in readings[:20]] + [us + reach + d for _, us, _ in readings[20:40] for d in (0, 1)] + times[:5]
    r = spark.createDataFrame(readings, "k string, us long, v double").withColumn("key", F.struct("k"))
    e = spark.createDataFrame(list(enumerate(times)), "event long, us long")
    measures = {"n": Measure(F.lit(1).cast("long"), F.sum), "total": Measure(F.col("v"), F.sum), "low": Measure(F.col("v"), F.min)}
    stretches = lookback_stretches(r, lookback, measures, hot_rows)
    assert stretches.count() <= 2 * len({(k, us) for k, us, _ in readings})
    met = within_stretches(stretches, e, lookback).select("event", "us", "key.k", "n", "total", "low")
    want = []
    for event, us in enumerate(times):
        for k in {k for k, _, _ in readings}:
            seen = [x for kk, t, x in readings if kk == k and us - reach <= t <= us]
            if seen:
                vs = [x for x in seen if x is not None]
                want.append((event, us, k, len(seen), sum(vs) if vs else None, min(vs, default=None)))
    assert sorted(map(tuple, met.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("lookback, unit", [(1, 1), (7, 20_000_000), (60, 1000)])
@pytest.mark.parametrize("kept, crowd, hot_rows", [(10**6, 0, 10**9), (10**6, 10**9, 10**9), (0, 0, 10**9), (0, 0, 20)])
def test_stretches_by_key_and_by_span_agree(spark, monkeypatch, lookback, unit, kept, crowd, hot_rows):
    """Keys that fit into a task and others, narrow slots and wide ones; times on the ends of windows, null times and values."""
    monkeypatch.setattr(lookback_module, "READINGS_OF_KEY", kept, raising=False)
    monkeypatch.setattr(lookback_module, "MANY_MET", crowd, raising=False)
    rng = random.Random(lookback)
    reach = lookback * MINUTE
    horizon = max(3 * reach // unit, 50)
    readings = [(rng.choice(["a", "b", None]), rng.randrange(-horizon, horizon) * unit, rng.choice([None, 1.0, 2.5])) for _ in range(150)]
    times = [rng.randrange(-horizon, horizon) * unit for _ in range(40)]
    times += [us + d for _, us, _ in readings[:20] for d in (-1, 0, 1, reach, reach + 1)]
    r = spark.createDataFrame([*readings, ("a", None, 1.0)], "k string, us long, v double").withColumn("key", F.struct("k"))
    e = spark.createDataFrame([*enumerate(times), (-1, None)], "event long, us long")
    stretches = lookback_stretches(r, lookback, {"total": Measure(F.col("v"), F.sum), "high": Measure(F.col("v"), F.max)}, hot_rows)
    met = within_stretches(stretches, e, lookback).select("event", "key.k", "total", "high")
    want = []
    for event, us in enumerate(times):
        for k in ("a", "b", None):
            seen = [x for kk, t, x in readings if kk == k and us - reach <= t <= us]
            vs = [x for x in seen if x is not None]
            if seen:
                want.append((event, k, sum(vs) if vs else None, max(vs, default=None)))
    assert sorted(map(tuple, met.collect()), key=repr) == sorted(want, key=repr)


def test_ordinary_keys_are_dealt_out_once(spark, monkeypatch):
    """No count key by key, and nothing written, before the stretches are: all work on a key happens where it is."""
    kept = []
    plain = lookback_module.written
    monkeypatch.setattr(lookback_module, "written", lambda df, label: kept.append(label) or plain(df, label))
    r = spark.range(500).select(F.struct("id").alias("key"), (F.col("id") * 1000).alias("us"))
    stretches = lookback_stretches(r, 5, {"n": Measure(F.lit(1).cast("long"), F.sum)})
    plan = stretches._jdf.queryExecution().executedPlan().toString()
    assert not kept and plan.count("Exchange hashpartitioning") == 1
    assert stretches.count() == 500


def test_least_values_keep_their_stretches_alone(spark, monkeypatch):
    """Sensors without a place: what is written is the stretches and the counts of the last join."""
    kept = []
    plain = lookback_module.written
    monkeypatch.setattr(lookback_module, "written", lambda df, label: kept.append(label) or plain(df, label))
    log = make_log(spark, [("e0", "go", 10), ("e1", "go", 40), ("e2", "go", 41)], [("e0", "p")])
    r = spark.createDataFrame([("d", "t", None, "x", v, at(m)) for v, m in ((3.0, 5), (2.0, 10), (None, 11), (4.0, 38))], READINGS)
    got = scenarios.aggregate_before_events(r, log, "go", "min", 30, False).select("ocel_event_id", "property_value")
    assert sorted(map(tuple, got.collect())) == [("e0", 2.0), ("e1", 2.0), ("e2", 4.0)]
    assert kept == ["stretches", "pairs"]


@pytest.mark.parametrize("func", ["mean", "min", "count"])
def test_intermediates_grow_with_readings_not_with_pairs(spark, monkeypatch, func):
    """40 keys and 500 events of one hour: 20,000 rows come out, but what is kept on the way is a few rows a reading."""
    readings = [(f"d{i}", "t", "p", "x", float(i), at(5)) for i in range(40)]
    log = make_log(spark, [(f"e{i}", "go", 10 + i / 100) for i in range(500)], [("e0", "p")])
    kept = []
    plain = lookback_module.written
    monkeypatch.setattr(lookback_module, "written", lambda df, label: kept.append(plain(df, label)) or kept[-1])
    got = scenarios.aggregate_before_events(spark.createDataFrame(readings, READINGS), log, "go", func, 30, False)
    assert got.count() == 40 * 500
    assert kept and all(df.count() <= 5 * len(readings) for df in kept)


def test_rounded_alike_by_place_and_by_time(spark):
    log = make_log(spark, [("e", "go", 10)], [("e", "p")])
    r = spark.createDataFrame([("d", "t", "p", "x", v, at(5)) for v in (1.0, 1.0, 2.0)], READINGS)
    for mapped in (True, False):
        got = scenarios.aggregate_before_events(r, log, "go", "mean", 30, mapped, digits=3).collect()
        assert [x.property_value for x in got] == [1.333]


@pytest.mark.parametrize("limit", [10, 100, 10**6])
def test_join_is_spread_by_pairs(spark, limit):
    """Keys with many rows on the left, on the right and on both, without a partner, and null."""
    left = [(0, i) for i in range(90)] + [(1, i) for i in range(2)] + [(2, 7)] * 30 + [(3, 1), (None, 1)]
    right = [(0, i) for i in range(3)] + [(1, i) for i in range(80)] + [(2, 5)] * 30 + [(4, 1), (None, 2)]
    a, b = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    got = join_spread(a, b, ["k"], limit)
    want = [(k, x, y) for k, x in left for kk, y in right if k is not None and k == kk]
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(want)


@pytest.mark.parametrize("lookback", [0, 30])
def test_pairs_of_one_moment_are_made_by_many_tasks(spark, monkeypatch, lookback):
    """Little goes in, a lot comes out: no task makes more than a small part of it, also where all share a slot."""
    monkeypatch.setattr(lookback_module, "PAIRS_PER_TASK", 5_000)
    r = spark.range(400).select(F.struct("id").alias("key"), F.lit(0).cast("long").alias("us"))
    times = spark.range(500).select(F.col("id").alias("event"), F.lit(0).cast("long").alias("us"))
    stretches = lookback_stretches(r, lookback, {"n": Measure(F.lit(1).cast("long"), F.sum)})
    made = within_stretches(stretches, times, lookback).groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in made) == 200_000
    assert max(x["count"] for x in made) < 40_000


@pytest.mark.parametrize("limit", [10, 200, 10**6])
def test_crowded_keys_are_cut_into_a_grid(spark, limit):
    """Keys with more rows than may be met at once on the right, on the left and on both, without a partner, and null."""
    left = [(0, 0), (4, 1), (None, 1)] + [(1, i) for i in range(90)] + [(2, i) for i in range(40)]
    right = [(0, i) for i in range(90)] + [(1, 0), (5, 1), (None, 2)] + [(2, i) for i in range(50)]
    a, b = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    got = join_spread(a, b, ["k"], limit, 7)
    assert got.columns == ["k", "a", "b"]
    want = [(k, x, y) for k, x in left for kk, y in right if k is not None and k == kk]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("lookback", [0, 30])
def test_one_reading_meets_few_events_at_once(spark, monkeypatch, lookback):
    """A join holds the pairs of a row in memory together, so one reading and many events of a moment are dealt out too."""
    monkeypatch.setattr(lookback_module, "MET_AT_ONCE", 100, raising=False)
    r = spark.range(1).select(F.struct("id").alias("key"), F.col("id").alias("us"))
    times = spark.range(4_000).select(F.col("id").alias("event"), (F.col("id") * 0).alias("us"))
    stretches = lookback_stretches(r, lookback, {"n": Measure(F.lit(1).cast("long"), F.sum)})
    made = within_stretches(stretches, times, lookback).groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in made) == 4_000
    assert max(x["count"] for x in made) < 4_000
