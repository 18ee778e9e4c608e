"""Hot groups take another way through the cluster and must give the same rows."""

import random
import statistics

import math

import pytest
from pyspark.sql import functions as F

from checks import tables
from sensorthread.operators import overview, scenarios
from sensorthread.operators.lookback import Measure, lookback_states
from sensorthread.operators.ordered import group_median, hot_keys, ordered_chunks, with_successor


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows, and more, in one group."""
    rng = random.Random(7)
    data = [("hot" if i % 2 else f"g{i % 11}", rng.randint(0, 40), i, float(rng.randint(0, 9))) for i in range(3000)]
    data += [(None, 1, 9000, 2.0), (None, 1, 9001, None), ("empty", 1, 9002, None)]
    return spark.createDataFrame(data, "g string, at int, id int, v double")


def test_successor(skewed):
    hot = hot_keys(skewed, ["g"], 500)
    assert [r._key.g for r in hot.collect()] == ["hot"]
    assert hot_keys(skewed, ["g"], 5000) is None
    plain = with_successor(skewed, ["g"], ["at", "id"], ["id", "v"], None)
    split = with_successor(skewed, ["g"], ["at", "id"], ["id", "v"], hot)
    assert rows(plain) == rows(split)


def test_chunks_are_even_and_in_order(skewed):
    chunks = ordered_chunks(skewed, ["g", "at", "id"])
    sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3003 / 8
    ends = chunks.groupBy("_chunk").agg(F.min(F.struct("g", "at", "id")).alias("a"), F.max(F.struct("g", "at", "id")).alias("b"))
    ordered = [(r.a, r.b) for r in ends.orderBy("_chunk").collect()]
    key = lambda r: (r.g or "", r.at, r.id)
    assert all(key(x[1]) < key(y[0]) for x, y in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_median_of_extremes(spark, hot_rows):
    rows = [("a", 1.7e308), ("a", 1.7e308), ("b", math.inf), ("b", 1.0), ("c", -math.inf), ("c", 2.0), ("c", math.nan)]
    df = spark.createDataFrame([*rows, ("d", None)], "g string, v double")
    got = {r.g: r.m for r in group_median(df, ["g"], "v", "m", hot_rows).collect()}
    assert got == {"a": 1.7e308, "b": math.inf, "c": 2.0, "d": None}


@pytest.mark.parametrize("hot_rows", [10, 500, 10**9])
def test_median(skewed, hot_rows):
    got = {r.g: r.m for r in group_median(skewed, ["g"], "v", "m", hot_rows).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append(r.v)
    want = {}
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None]
        want[g] = statistics.median(vs) if vs else None
    assert got == want


def test_median_of_windows_in_hot_groups(spark, sf_dir):
    readings = tables.iot(spark, sf_dir)
    plain = scenarios.object_payload_by_window(readings, "median", 1440)
    split = scenarios.object_payload_by_window(readings, "median", 1440, hot_rows=2)
    assert rows(plain) == rows(split)


def test_directly_follows_with_hot_objects(spark, sf_dir):
    log = tables.trade_log(spark, sf_dir)
    assert rows(overview.directly_follows(log)) == rows(overview.directly_follows(log, hot_rows=20))


def test_a_relation_under_two_qualifiers_counts_once(spark, sf_dir):
    log = tables.trade_log(spark, sf_dir)
    want_follows, want_ends = rows(overview.directly_follows(log)), rows(overview.start_and_end_activities(log))
    log["event_object"] = log["event_object"].unionByName(
        log["event_object"].withColumn("ocel_qualifier", F.lit("again"))
    )
    assert rows(overview.directly_follows(log)) == want_follows
    assert rows(overview.start_and_end_activities(log)) == want_ends


MINUTE = 60_000_000


@pytest.mark.parametrize("lookback, unit", [(0, 1000), (1, 1), (7, 20_000_000), (60, 1000)])
@pytest.mark.parametrize("hot_rows", [20, 10**9])
def test_lookback_against_brute_force(spark, lookback, unit, hot_rows):
    rng = random.Random(lookback + unit)
    reach = lookback * MINUTE
    horizon = max(4 * reach // unit, 50)
    readings = [
        ("hot" if i % 3 == 0 else f"k{i % 5}", rng.randrange(-horizon, horizon) * unit, rng.choice([None, 1.0, 2.0, 5.5]))
        for i in range(400)
    ]
    probes = [("hot" if i % 3 == 0 else f"k{i % 6}", rng.randrange(-horizon, horizon) * unit) for i in range(150)]
    # Times on the very ends of windows.
    probes += [(k, us) for k, us, _ in readings[:30]] + [(k, us + reach) for k, us, _ in readings[30:60]]
    r = spark.createDataFrame(readings, "k string, us long, v double").withColumn("key", F.struct("k"))
    p = spark.createDataFrame(probes, "k string, us long").withColumn("key", F.struct("k"))
    v = F.col("v")
    states = lookback_states(
        r,
        p,
        lookback,
        {
            "n": Measure(F.lit(1).cast("long"), F.sum),
            "known": Measure(F.when(v.isNotNull(), 1).otherwise(0).cast("long"), F.sum),
            "total": Measure(v, F.sum),
            "low": Measure(v, F.min),
            "high": Measure(v, F.max),
            "last": Measure(F.col("us"), F.max),
        },
        hot_rows,
    )
    got = sorted(
        (tuple(x) for x in states.select("key.k", "us", "n", "known", "total", "low", "high", "last").collect()), key=repr
    )
    want = []
    for k, us in set(probes):
        seen = [(t, x) for kk, t, x in readings if kk == k and us - reach <= t <= us]
        if seen:
            vs = [x for _, x in seen if x is not None]
            want.append(
                (k, us, len(seen), len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None), max(t for t, _ in seen))
            )
    assert got == sorted(want, key=repr)
