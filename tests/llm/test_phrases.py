"""Phrases against a count of all of them."""

import random
from collections import Counter, defaultdict

import pytest

from sensorthread.llm import phrases
from tests.llm.helpers import awkward, documents, empty

SMALL = phrases.Limits(entries=60, burst=5, chunk=7, hold=20, block=50, pair_block=90, run_words=400, part_words=300)


def brute_force(rows, least, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in phrases.PIECE_ENDS:
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: v for p, v in f.items() if v >= least}
        covered = {
            p[i : i + k] for p, v in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * v >= 100 * f[p[i : i + k]]
        }
        rows = []
        for p, a in often.items():
            if len(p) > 1 and p not in covered:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n, -score)
    return out


def found(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "a", "é", "river", "Stone", "#1", "x\x0b", "\x01y"]
    rare = [f"w{i}" for i in range(300)]
    common = "the river of a Stone bridge over the river"
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(rare) if rng.random() < 0.2 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]))
        rows.append((i, "".join(parts) + (f" {common}" * (i % 3)), rng.choice(["en", "de", None, "en"])))
    return rows


@pytest.mark.parametrize("limits", [phrases.Limits(), SMALL])
@pytest.mark.parametrize("top", [7, 2000])
def test_all_phrases(spark, limits, top):
    rows = corpus(1, 150)
    df = documents(spark, rows).repartition(3)
    assert found(phrases.collocations(df, 6, top, limits)) == brute_force([(r[2], r[1]) for r in rows], 6, top)


def test_a_text_longer_than_a_run_and_a_prefix_larger_than_a_merge(spark):
    rng = random.Random(2)
    long = " ".join(f"v{rng.randrange(900)}" for _ in range(4000))
    hot = " ".join(f"hot pair {rng.choice('abcdef')} {rng.choice('ghijkl')} {rng.choice('mnopqr')}" for _ in range(900))
    rows = [(1, long, "en"), (2, hot, "en"), (3, long + " " + hot, None)]
    got = found(phrases.collocations(documents(spark, rows), 3, 2000, SMALL))
    assert got == brute_force([(r[2], r[1]) for r in rows], 3, 2000)


def test_products_beyond_64_bits(spark):
    counts = [("en", "a b", 2, 4 * 10**9), ("en", "a", 1, 4 * 10**9), ("en", "b", 1, 5 * 10**9), ("en", "c", 1, 10**12)]
    found_ = spark.createDataFrame(counts, "lang string, phrase string, size int, f bigint")
    totals = found_.where("size = 1").groupBy("lang").agg({"f": "sum"}).toDF("lang", "n")
    row = phrases.scored(found_, totals).first()
    n = 10**12 + 9 * 10**9
    assert (row.a, row.l, row.r, row.score) == (4 * 10**9, 4 * 10**9, 5 * 10**9, 1000 * 4 * 10**9 * n // (4 * 10**9 * 5 * 10**9))


def test_awkward_rows(spark):
    rows = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert found(phrases.collocations(awkward(spark), 2, 50, SMALL)) == brute_force(rows, 2, 50)
    assert found(phrases.collocations(empty(spark))) == {}
