"""Scenarios on a small log, against plain Python."""

import random
import statistics
from datetime import datetime, timedelta

import pytest

from sensorthread.functions.conditions import Bound, Condition, threshold_predicate
from sensorthread.operators import maps, scenarios
from sensorthread.operators.log import EventLog

T0 = datetime(2024, 5, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


READINGS = "device_id string, device_type string, location string, property string, property_value double, result_time timestamp_ntz"


def make_log(spark, events, relations, objects=()):
    """events: (id, type, minute); relations: (event, object); objects: (id, type)."""
    types = sorted({e[1] for e in events} | {"idle"})
    log = EventLog(
        {
            "event": spark.createDataFrame([(e[0], e[1]) for e in events], "ocel_id string, ocel_type string"),
            "event_object": spark.createDataFrame(
                [(e, o, "") for e, o in relations], "ocel_event_id string, ocel_object_id string, ocel_qualifier string"
            ),
            "event_map_type": spark.createDataFrame([(t, t) for t in types], "ocel_type string, ocel_type_map string"),
            "object": spark.createDataFrame(list(objects), "ocel_id string, ocel_type string"),
            "object_map_type": spark.createDataFrame(
                sorted({(t, t) for _, t in objects}), "ocel_type string, ocel_type_map string"
            ),
        }
    )
    for t in types:
        rows = [(e[0], at(e[2])) for e in events if e[1] == t]
        log[f"event_{t}"] = spark.createDataFrame(rows, "ocel_id string, ocel_time timestamp_ntz")
    for t in {t for _, t in objects}:
        log[f"object_{t}"] = spark.createDataFrame(
            [(i, T0, None) for i, kind in objects if kind == t],
            "ocel_id string, ocel_time timestamp_ntz, ocel_changed_field string",
        )
    return log


@pytest.fixture(scope="module")
def world(spark):
    """Devices that move between places, events with several objects, repeated relations, equal times, null places; one
    device and one place hold a third of the rows."""
    rng = random.Random(3)
    places = ["p0", "p1", "p2", "p3", None]
    readings = []
    for i in range(600):
        device = "d0" if i % 3 == 0 else f"d{rng.randrange(1, 6)}"
        readings.append(
            (device, "t", rng.choice(places), rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.5, 4.0]), at(rng.randrange(0, 400) * 3))
        )
    events = [(f"e{i}", rng.choice(["go", "stop"]), rng.randrange(0, 420) * 3) for i in range(90)]
    relations = [(e[0], "p0" if i % 3 == 0 else rng.choice(["p0", "p1", "p2", "none"])) for i, e in enumerate(events)]
    relations += [(e[0], "p1") for e in events[:30]] + relations[:10]
    return readings, events, relations


def joined(world, kind, lookback, mapped, once=False):
    """(reading, event id, event time) for every match, by the definition."""
    readings, events, relations = world
    out = []
    held = {(r[0], r[2]) for r in readings}
    for e, etype, minute in events:
        if etype != kind:
            continue
        if mapped:
            via = [d for ev, o in relations if ev == e for d, p in held if p is not None and p == o]
            via = sorted(set(via)) if once else via
            pairs = [r for d in via for r in readings if r[0] == d]
        else:
            pairs = readings
        out += [(r, e, at(minute)) for r in pairs if at(minute - lookback) <= r[5] <= at(minute)]
    return out


def null_last(v):
    return (v is None, v)


def frames(spark, world):
    readings, events, relations = world
    return spark.createDataFrame(readings, READINGS), make_log(spark, events, relations)


@pytest.mark.parametrize("mapped", [True, False])
@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_closest(spark, world, mapped, hot_rows):
    readings, log = frames(spark, world)
    best = {}
    for r, e, t in joined(world, "go", 60, mapped):
        rank = ((t - r[5]), null_last(r[0]), (r[4] is None, r[4] or 0), (r[2] is None, r[2] or ""))
        key = (e, r[3])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (r[0], r[1], r[2], r[3], r[4], e, t))
    got = scenarios.closest_before_events(readings, log, "go", mapped, hot_rows=hot_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((b[1] for b in best.values()), key=repr)
    keep = threshold_predicate([Condition("x", lower=Bound(2))])
    got = scenarios.closest_before_events(readings, log, "go", mapped, keep=keep)
    want = [b[1] for b in best.values() if b[1][3] == "x" and b[1][4] is not None and b[1][4] >= 2]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("mapped", [True, False])
@pytest.mark.parametrize("func", ["max", "min", "mean", "median", "sum", "count", "stddev"])
def test_aggregates(spark, world, mapped, func):
    readings, log = frames(spark, world)
    groups = {}
    for r, e, t in joined(world, "go", 75, mapped):
        groups.setdefault((r[0], r[1], r[2], r[3], e, t), []).append(r[4])
    functions = {
        "max": max,
        "min": min,
        "mean": statistics.fmean,
        "median": statistics.median,
        "sum": sum,
        "count": lambda vs: float(len(vs)),
        "stddev": lambda vs: statistics.stdev(vs) if len(vs) > 1 else None,
    }
    want = {}
    for key, vs in groups.items():
        vs = [v for v in vs if v is not None]
        want[key] = functions[func](vs) if vs or func == "count" else None
    got = scenarios.aggregate_before_events(readings, log, "go", func, 75, mapped, hot_rows=20)
    rows = got.collect()
    found = {(r.device_id, r.device_type, r.location, r.property, r.ocel_event_id, r.result_time): r.property_value for r in rows}
    assert len(rows) == len(found) and set(found) == set(want)
    for key, value in want.items():
        assert found[key] == (None if value is None else pytest.approx(value, abs=1e-9)), key


@pytest.mark.parametrize("mapped", [True, False])
@pytest.mark.parametrize("lookback", [0, 9, 60])
def test_matches(spark, world, mapped, lookback):
    readings, log = frames(spark, world)
    groups = {}
    for r, e, t in joined(world, "stop", lookback, mapped):
        groups.setdefault((e, t), []).append(int((t - r[5]).total_seconds() // 60))
    want = sorted((e, t, len(a), max(a), min(a)) for (e, t), a in groups.items())
    got = scenarios.matches_before_events(readings, log, "stop", lookback, mapped, hot_rows=10)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("lookback", [0, 75])
@pytest.mark.parametrize("mapped", [True, False])
def test_window_medians_with_and_without_hot_spans(spark, world, mapped, lookback):
    readings, log = frames(spark, world)
    groups = {}
    for r, e, t in joined(world, "go", lookback, mapped, once=True):
        groups.setdefault((r[0], r[2], r[3], e), []).append(r[4])
    want = {k: [v for v in vs if v is not None] for k, vs in groups.items()}
    want = {k: statistics.median(vs) if vs else None for k, vs in want.items()}
    for hot_rows in (30, 10**9):
        got = scenarios.aggregate_before_events(readings, log, "go", "median", lookback, mapped, hot_rows=hot_rows)
        assert {(r.device_id, r.location, r.property, r.ocel_event_id): r.property_value for r in got.collect()} == want


def test_ranks_of_several_digits(spark):
    from pyspark.sql import functions as F

    from sensorthread.operators.window_median import window_medians

    rng = random.Random(5)
    data = [(m * 1000, rng.choice([None, rng.random(), 0.5])) for m in range(1500)]
    probes = [rng.randrange(0, 1600) * 1000 for _ in range(60)]
    r = spark.createDataFrame(data, "us long, v double").withColumn("key", F.struct(F.lit("a").alias("k")))
    p = spark.createDataFrame([(t,) for t in probes], "us long").withColumn("key", F.struct(F.lit("a").alias("k")))
    want = {}
    for t in probes:
        seen = [v for us, v in data if us <= t and v is not None]
        want[t] = statistics.median(seen) if seen else None
    for array_rows, task_rows in ((10**9, 10**9), (50, 10**9), (50, 60)):
        assert {x.us: x.value for x in window_medians(r, p, 1, array_rows, task_rows).collect()} == want


def test_medians_of_arrays_tasks_and_digits_agree(spark):
    from pyspark.sql import functions as F

    from sensorthread.operators.window_median import window_medians

    rng = random.Random(6)
    inf, nan = float("inf"), float("nan")
    data = [
        (k, rng.randrange(300) * 1_000_000, rng.choice([None, inf, -inf, nan, 0.0, 1e308, rng.gauss(0, 1), rng.gauss(0, 1)]))
        for k, n in (("few", 20), ("many", 400), ("most", 1500), (None, 300))
        for _ in range(n)
    ]
    probes = [(k, rng.randrange(-100, 500) * 1_000_000) for k in ("few", "many", "most", None, "unread") for _ in range(40)]
    keyed = [spark.createDataFrame(rows, types).withColumn("key", F.struct("k")) for rows, types in ((data, "k string, us long, v double"), (probes, "k string, us long"))]

    def medians(lookback, array_rows, task_rows):
        found = window_medians(*keyed, lookback, array_rows, task_rows).collect()
        assert len({(x.key.k, x.us) for x in found}) == len(found)
        return {(x.key.k, x.us): repr(x.value) for x in found}

    for lookback in (0, 1):
        want = medians(lookback, 10**9, 10**9)
        assert want and medians(lookback, 15, 10**9) == want and medians(lookback, 15, 700) == want


@pytest.mark.parametrize("once", [True, False])
def test_at_events(spark, world, once):
    readings, log = frames(spark, world)
    got = scenarios.object_payload_at_events(readings, log, ["go"], once=once)
    want = [(r[0], r[1], r[2], r[3], r[4], e, t) for r, e, t in joined(world, "go", 0, True, once)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_window_is_closed_at_both_ends(spark):
    log = make_log(spark, [("e", "go", 100)], [("e", "p")])
    rows = [("d", "t", "p", "x", float(m), at(m)) for m in (39, 40, 100, 101)]
    readings = spark.createDataFrame(rows, READINGS)
    got = scenarios.aggregate_before_events(readings, log, "go", "sum", 60, True).first()
    assert got.property_value == 140.0


def test_a_failing_closest_reading_hides_an_older_one(spark):
    log = make_log(spark, [("e", "go", 100)], [("e", "p")])
    rows = [("d", "t", "p", "x", 9.0, at(80)), ("d", "t", "p", "x", 1.0, at(90))]
    readings = spark.createDataFrame(rows, READINGS)
    keep = threshold_predicate([Condition("x", lower=Bound(5))])
    assert scenarios.closest_before_events(readings, log, "go", True, keep=keep).isEmpty()


def test_text_values_are_cast(spark):
    rows = [("d", "t", "p", "x", "1.5", at(0)), ("d", "t", "p", "x", "2.5", at(1))]
    readings = spark.createDataFrame(rows, READINGS.replace("double", "string"))
    got = scenarios.object_payload_by_window(readings, "mean", 60).first()
    assert (got.property_value, got.result_time, got.time_window) == (2.0, at(1), at(0))
    bad = spark.createDataFrame([("d", "t", "p", "x", "n/a", at(0))], READINGS.replace("double", "string"))
    with pytest.raises(Exception):
        scenarios.object_payload_by_window(bad, "mean", 60).collect()


def test_choice():
    assert scenarios.choose_scenario("1", []).value == "B"
    assert scenarios.choose_scenario("1", ["x"]).value == "A"
    assert scenarios.choose_scenario("2", []).value == "C"
    with pytest.raises(ValueError):
        scenarios.choose_scenario("3", [])


def test_unknown_event_type(spark, world):
    readings, log = frames(spark, world)
    with pytest.raises(ValueError):
        scenarios.object_payload_at_events(readings, log, ["absent"])


def test_is_mapped(spark, world):
    readings, log = frames(spark, world)
    assert scenarios.is_mapped(readings, log, "go")
    assert not scenarios.is_mapped(readings, log, "idle")
    assert not scenarios.is_mapped(readings.where("location IS NULL"), log, "go")


def test_a_null_device_type_remains_for_ever(spark):
    readings = spark.createDataFrame([(None, "p", "d"), ("t", "p", "d")], "device_type string, location string, device_id string")
    objects = spark.createDataFrame([("p", "truck")], "ocel_id string, ocel_type string")
    done = spark.createDataFrame([("t", "truck"), (None, "truck")], "device_type string, ocel_type string")
    left = maps.remaining_count(readings, objects, done).first()
    assert (left.remaining, left.without_device_type) == (1, 1)
    assert maps.remaining_device_types(readings, objects, done).isEmpty()
    assert maps.remaining_device_types(readings, objects, done.limit(0)).collect() == [("t",)]


def test_refining_keeps_all_readings_of_a_device(spark):
    rows = [("d1", "t", "a"), ("d1", "t", "b"), ("d2", "t", "b"), ("d1", "u", "a")]
    readings = spark.createDataFrame(rows, "device_id string, device_type string, location string")
    objects = spark.createDataFrame([("a", "truck"), ("b", "yard")], "ocel_id string, ocel_type string")
    kept = maps.refine_source(readings, "t", objects, "truck")
    assert sorted(map(tuple, kept.select("device_id", "location").collect())) == [("d1", "a"), ("d1", "b")]
    assert maps.refine_source(readings, "t", objects, "NONE").count() == 3
