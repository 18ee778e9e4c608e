"""Whitening against fractions and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sensorthread.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def numbers(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute_force(rows, components=16):
    kept = [(i, numbers(v)) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array(
        [[float(sum((n * x[j] - sums[j]) * (n * x[k] - sums[k]) for x in fit) / Fraction(n**3)) for k in range(d)] for j in range(d)]
    )
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in kept:
        centred = np.array([float(x[j] - Fraction(sums[j], n)) for j in range(d)])
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        out[i] = (deviation, [abs(centred @ vectors[:, c]) / math.sqrt(values[c]) for c in order])
    return n, out, [values[c] / np.trace(cov) for c in order]


def vectors(seed, n, d):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(j, 1 + j / 3) for j in range(d)]) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(40)]  # A third of them repeat.


@pytest.mark.parametrize("d", [3, 20])
def test_against_fractions(spark, d):
    rows = vectors(1, 90, d)
    made, model, error = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5))
    n, want, explained = brute_force(rows)
    assert model.n == n and error < 1e-9 and np.allclose(model.explained, explained, rtol=1e-9)
    got = {r.id: r for r in made.collect()}
    assert set(got) == set(want)
    for i, (deviation, parts) in want.items():
        assert got[i].deviation == deviation
        assert np.allclose(np.abs(got[i].whitened), parts, rtol=1e-6, atol=1e-9)


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 1e6, rng.uniform(-1, 1), rng.uniform(-1, 1) * 1e9]) for i in range(30)]
    made, model, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    fit = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = [sum((n * a - s) * (n * a - s) for a in col) for col, s in zip(zip(*fit), sums)]
    assert model.sums == sums and math.isclose(model.trace, sum(exact) / n**3, rel_tol=1e-15)
    for r, (_, v) in zip(sorted(made.collect()), rows):
        want = sum((n * (math.floor(64 * c) + 1_000_000) - s) ** 2 for c, s in zip(v, sums))
        assert r.deviation == (want if want < 2**63 else None)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]),
        (None, [1.0, 2.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (9, [0.0, 5.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS id", "1 AS x", "2 AS whitened", "3 AS n")
    made, model, error = whitening.whiten(df)
    assert sorted((r.id or 0) for r in made.collect()) == [0, 8, 8, 9] and model.n == 3 and error < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)
    made, model, error = whitening.whiten(same)
    assert [(r.deviation, r.whitened) for r in made.collect()] == [(0, [])] * 3 and model.n == 1
    made, model, error = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert made.collect() == [] and model is None
