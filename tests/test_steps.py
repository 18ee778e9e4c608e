"""Directly-follows graph and first and last activities, against plain Python on an odd log."""

import random
from collections import defaultdict

import pytest

from sensorthread import apply_session_defaults
from sensorthread.operators import ordered, overview

from .test_scenarios import at, make_log


@pytest.fixture(scope="module")
def odd(spark):
    """Equal times, ids whose order is not that of their numbers, repeated relations, relations of unknown events and objects,
    objects with the same pairs of events, an id that stands in two event tables, null ids."""
    rng = random.Random(11)
    events = [(f"e{i}", rng.choice(["go", "stop", "wait"]), rng.randrange(12)) for i in range(60)]
    events.append(("e7", "again", 5))
    objects = [(f"{kind}{i}", kind) for kind in ("box", "car") for i in range(6)]
    relations = [(e[0], rng.choice(objects)[0]) for e in events for _ in range(2)]
    relations += [(e, "box5") for e, o in relations if o == "box4"] + relations[:15]
    relations += [("none", "box1"), ("e3", "nobody"), (None, "box1"), ("e4", None), ("é", "car1"), ("e7", "car2")]
    events.append(("é", "go", 3))
    return events, relations, objects


def lives(odd):
    events, relations, objects = odd
    kinds = dict(objects)
    steps = defaultdict(set)
    for e, o in relations:
        for i, activity, minute in events:
            if i == e and o in kinds:
                steps[o].add((minute, i.encode(), activity))
    return {(kinds[o], o): sorted(s) for o, s in steps.items()}


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_directly_follows_of_an_odd_log(spark, odd, hot_rows):
    occurrences, objects, pairs = defaultdict(int), defaultdict(set), defaultdict(set)
    for (kind, o), life in lives(odd).items():
        for a, b in zip(life, life[1:]):
            if a[1] != b[1]:
                edge = (kind, a[2], b[2])
                occurrences[edge] += 1
                objects[edge].add(o)
                pairs[edge].add((a[1], b[1]))
    got = overview.directly_follows(make_log(spark, *odd), hot_rows)
    assert got.columns == ["object_type", "activity", "next_activity", "occurrences", "objects", "event_pairs"]
    want = [(*e, occurrences[e], len(objects[e]), len(pairs[e])) for e in occurrences]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_and_last_of_an_odd_log(spark, odd):
    counts = defaultdict(lambda: [0, 0])
    for (kind, _), life in lives(odd).items():
        counts[kind, life[0][2]][0] += 1
        counts[kind, life[-1][2]][1] += 1
    got = overview.start_and_end_activities(make_log(spark, *odd))
    assert sorted(map(tuple, got.collect())) == sorted((*k, *v) for k, v in counts.items())


def test_steps_are_not_kept_and_ids_go_no_further_than_their_events(spark, odd, monkeypatch):
    """Neither query writes the steps of ordinary objects; what is shuffled by object has a number in place of an id."""
    kept = []
    plain = overview.written
    monkeypatch.setattr(overview, "written", lambda df, label: kept.append(label) or plain(df, label))
    log = make_log(spark, *odd)
    overview.directly_follows(log).collect()
    overview.start_and_end_activities(log).collect()
    assert not kept
    assert dict(overview._steps(log).dtypes)["event"] == "bigint"


@pytest.fixture(scope="module")
def crowded(spark):
    """Events of one object, of several that share pairs of events, and of more objects than there are bits."""
    rng = random.Random(5)
    objects = [(f"{kind}{i}", kind) for kind in ("box", "car") for i in range(50)]
    events = [(f"e{i:02}", rng.choice(["go", "stop"]), i) for i in range(40)] + [("e07", "again", 9)]
    sizes = [1, 1, 2, 3, 45, 90]
    relations = [(e[0], o[0]) for e in events for o in rng.sample(objects, rng.choice(sizes))]
    return events, relations + [(e, "alone") for e in ("e01", "e03", "e05")], objects + [("alone", "car")]


def test_events_know_their_other_objects(spark, crowded):
    """Without the bits every pair of events went through the shuffle that counts pairs but once."""
    events, relations, _ = crowded
    places = defaultdict(set)
    for e, o in relations:
        places[e].add(o)
    bits = {r.o: r.b for r in spark.createDataFrame([(o,) for o in {o for _, o in relations}], "o string").selectExpr("o", "shiftleft(1, cast(pmod(xxhash64(o), 32) as int)) b").collect()}
    want = set()
    for e, _, minute in events:
        for o in places[e]:
            mask = 0
            for other in places[e] - {o}:
                mask |= bits[other] & 0xFFFFFFFF
            want.add((o, at(minute), -1 if e == "e07" else mask - (1 << 32) if mask >> 31 else mask))
    got = overview._steps(make_log(spark, *crowded)).select("object", "time", "others").collect()
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("rows", [10, 10**9])
def test_pairs_met_at_several_objects_count_once(spark, crowded, monkeypatch, rows):
    monkeypatch.setattr(ordered, "FEW_ROWS", rows)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows)
    counts = defaultdict(lambda: [0, set(), set()])
    for (kind, o), life in lives(crowded).items():
        for a, b in zip(life, life[1:]):
            if a[1] != b[1]:
                entry = counts[kind, a[2], b[2]]
                entry[0] += 1
                entry[1].add(o)
                entry[2].add((a[1], b[1]))
    assert any(len(pairs) < n for n, _, pairs in counts.values())
    got = overview.directly_follows(make_log(spark, *crowded))
    assert sorted(map(tuple, got.collect())) == sorted((*k, n, len(o), len(p)) for k, (n, o, p) in counts.items())


def test_partitions_follow_the_rows(spark):
    assert ordered.pieces(spark, 1_000) is None
    assert ordered.pieces(spark, 100_000_000) == 100
    assert ordered.crowding(spark.createDataFrame([("a",), ("a",), (None,)], "g string"), ["g"]) == (3, 2)
    assert ordered.crowding(spark.createDataFrame([], "g string"), ["g"]) == (0, 0)


def test_tasks_read_little_at_once(spark):
    reads = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in reads}
    try:
        for given, most in (("128MB", 24 << 20), ("3m", 3 << 20)):
            for name in reads:
                spark.conf.set(name, given)
            apply_session_defaults(spark)
            for name in reads:
                text = spark.conf.get(name)
                assert (int(text) if text.isdigit() else 3 << 20) <= most
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
