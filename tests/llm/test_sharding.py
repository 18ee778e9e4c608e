"""Shards against a plain sort."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from sensorthread.llm import sharding
from tests.llm.helpers import awkward, documents, empty


def place(doc_id, text):
    by_text = "-" * 16 if text is None else hashlib.md5(text.encode()).hexdigest()[:16]
    return by_text, hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()


def size(text):
    return len((text or "").encode()) + 8


def brute_force(rows, shards):
    """Shard of each row, with texts of many bytes cut anywhere and others kept together."""
    rows = sorted(rows, key=lambda r: place(*r))
    total = sum(size(t) for _, t in rows)
    copies = Counter()
    for _, t in rows:
        copies[place(0, t)[0]] += size(t)
    at, heads, out = 0, {}, defaultdict(list)
    for i, t in rows:
        h = place(i, t)[0]
        head = heads.setdefault(h, at)
        first = head if copies[h] * shards * 100 <= total else at
        out[first * shards // total].append((i, t))
        at += size(t)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randrange(60) + str(rng.randrange(10**9))) for i in range(n)]
    rows += [(n + i, "one text that a third of all rows have, as a copy") for i in range(n // 2)]
    return rows + [(2 * n + i, f"pair {i // 2}") for i in range(n // 4)]


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_are_those_of_a_sort(spark, parts):
    rows = corpus(1, 2400)
    got = defaultdict(dict)
    for r in sharding.shard(documents(spark, rows).repartition(parts), 5).collect():
        assert got[r.shard].setdefault(r.slot, (r.doc_id, r.text)) == (r.doc_id, r.text) and r.size == size(r.text)
    want = brute_force(rows, 5)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    sizes = [sum(size(t) for _, t in v) for v in want.values()]
    assert max(sizes) - min(sizes) < sum(sizes) / 5 * 0.03


def test_overfull_ranges_are_subdivided(spark):
    rows = corpus(2, 1200)
    df = sharding.shard(documents(spark, rows), 4, ranges=2, draws=8, piece_rows=50, piece_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in df) == Counter(rows)
    by_shard = defaultdict(list)
    for r in df:
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == [0, 1, 2, 3]
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r.size for r in m) for m in by_shard.values()]
    assert max(sizes) - min(sizes) < sum(sizes) / 4 * 0.03


def test_splitters_stand_at_even_steps_of_the_bytes(spark):
    rows = corpus(3, 4000)
    keys = documents(spark, rows).select(sharding.text_size(sharding.F.col("text")).alias("size"), *sharding._place())
    total = sum(size(t) for _, t in rows)
    cuts = sharding.splitters(keys, total, 20, 50)
    assert 15 <= len(cuts) <= 20  # 19 steps, and where the text begins that several of them fall into.
    bytes_of = [0] * (len(cuts) + 1)
    for i, t in rows:
        bytes_of[sum(c <= "".join(place(i, t)) for c in cuts)] += size(t)
    assert max(bytes_of) < 2 * total / 20


def test_awkward_rows(spark):
    df = sharding.shard(awkward(spark), 3)
    assert df.columns == [c for c in awkward(spark).columns if c != "size"] + ["size", "shard", "slot"]
    got = df.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in awkward(spark).collect())
    assert sharding.shard(empty(spark)).collect() == []
