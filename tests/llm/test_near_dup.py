import random

import pytest

from sensorthread.llm import near_dup
from sensorthread.llm.graph import connected_components
from tests.llm.helpers import awkward, documents, empty, prose


def brute_force(rows, width, part, whole):
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        if not words:
            return frozenset()
        n = min(width, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies of all sizes and degrees, a passage in half of all texts, short texts, and unlike ones."""
    rng = random.Random(3)
    passage = prose(99, 30)
    texts = []
    for group in range(12):
        base = prose(group, rng.choice([6, 40, 120, 400]))
        texts += [base, base.upper(), base + " "]
        texts += [edited(base, rng, rng.randrange(1, 4)) for _ in range(12)]
    chain = prose(77, 150)
    for _ in range(12):
        texts.append(chain)
        chain = edited(chain, rng, 3)
    texts += [passage + " " + prose(1000 + i, rng.choice([10, 20, 60])) for i in range(40)]
    texts += [prose(2000 + i, rng.randrange(1, 6)) for i in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width, part, k, wide", [(3, 85, 32, 256), (5, 80, 32, 256), (3, 85, 32, 64)])
def test_against_all_pairs(spark, corpus, width, part, k, wide):
    got = near_dup.near_duplicates(documents(spark, corpus), width, part, 100, k, wide).collect()
    want = brute_force(corpus, width, part, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(corpus)


def test_awkward_rows(spark):
    rows = [tuple(r)[:3] for r in near_dup.near_duplicates(awkward(spark), 3, 85, 100).collect()]
    assert len(rows) == 11
    assert rows.count((5, 1, 5)) == 2 and (1, 0, 1) in rows and (3, 0, 3) in rows
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_stays(spark):
    docs = awkward(spark)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # Both texts of id 6 stay, as they are no near-duplicates, and one of the two equal rows of id 5.
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 6, 6, 7] and ids.count(None) == 2
    assert near_dup.keep_one(empty(spark)).count() == 0
    base = prose(5, 100)
    copies = documents(spark, [(9, base), (8, base + " more"), (10, prose(6, 100)), (None, base)])
    assert sorted(r.doc_id for r in near_dup.keep_one(copies).collect()) == [8, 10]
    # Near-duplicates that share the least id, and a group without any.
    other = prose(7, 100)
    rows = [(8, base), (8, base + " more"), (8, prose(6, 100)), (None, other), (None, other + " more"), (None, other)]
    assert sorted(r.doc_id or 0 for r in near_dup.keep_one(documents(spark, rows)).collect()) == [0, 8, 8]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    links = spark.createDataFrame(path, "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
