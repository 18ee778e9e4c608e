import pytest
from pyspark.sql import functions as F

from sensorthread.llm import mixing
from tests.llm.helpers import awkward, documents, empty


def water(sizes, weights, most=3):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("a", 40), ("b", 3), ("c", 300), ("Z", 5), (None, 20), ("é", 8)):
        for k in range(n):
            rows.append((i, "w " * (k % 17), None, source, None))
            i += 1
    return documents(spark, rows)


def test_targets_and_takes(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = water(sizes, mixing.WEIGHTS)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert [r.position for r in rows if r.position] == sorted(r.position for r in rows if r.position)


def test_order_does_not_depend_on_partitions(spark):
    rows = [(None if i % 3 else i % 7, f"w{i % 11} " * (i % 5 + 1), None, "ab"[i % 2], None) for i in range(200)]
    one, many = (
        [(r.doc_id, r.text, r.reading, r.position) for r in mixing.training_order(documents(spark, rows).repartition(n)).collect()]
        for n in (1, 7)
    )
    assert one == many and [r[3] for r in one] == sorted(r[3] for r in one)


def test_order_follows_the_schedule(docs):
    rows = mixing.training_order(docs).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    words = {}
    for r in rows:
        words.setdefault(r.source, []).append((r.position, r.words))
    # The first source by name, Z, falls from 1.5 to 0.5: most of its words come in the first half.
    early = sum(n for p, n in words["Z"] if p < 0.5) / sum(n for _, n in words["Z"])
    assert early == pytest.approx(0.625, abs=0.12)
    late = sum(n for p, n in words["b"] if p < 0.5) / sum(n for _, n in words["b"])
    assert late == pytest.approx(0.25 / 0.875, abs=0.12)
    total = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.taken}
    read = {}
    for r in rows:
        read[r.doc_id] = read.get(r.doc_id, 0) + r.words
    assert read == total


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_times_invert_the_integral(spark, schedule):
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("s"))
    for s, t in shares.select("s", mixing.due_time(F.col("s"), schedule)).collect():
        area, total = 0.0, 0.0
        for (t0, m0), (t1, m1) in zip(schedule, schedule[1:]):
            total += (m0 + m1) / 2 * (t1 - t0)
            x = min(max(t - t0, 0), t1 - t0)
            area += m0 * x + (m1 - m0) / (t1 - t0) * x * x / 2
        assert area / total == pytest.approx(s, abs=1e-9)


def test_awkward_rows(spark):
    rows = mixing.mix_report(awkward(spark)).collect()
    assert len(rows) == 11 and sum(r.size for r in rows) == 30_000 + 5 + 3 + 3 + 2 + 2 + 6
    order = mixing.training_order(awkward(spark))
    assert order.columns[-3:] == ["words", "reading", "position"] and order.where("doc_id = 2").count() == 0
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.training_order(empty(spark)).count() == 0
