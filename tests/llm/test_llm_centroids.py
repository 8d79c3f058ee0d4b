"""Exact k-means by annulus search against brute force in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyframe.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, k, rounds, size, scale=64):
    kept = [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == size and all(x is not None and math.isfinite(np.float32(x)) for x in r[1])]
    digest = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in set(of):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i is not None, i or 0), tuple(v), near(v)[1], near(v)[0]) for i, v in kept), cents


def told(out):
    return sorted(((r.key is not None, r.key or 0), tuple(r.v), r.cluster, r.distance) for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([rng.gauss(0, 1), rng.randrange(-2, 3) / 64]) * rng.choice([0.1, 1, 5]) for _ in range(4)]
    rows = [(i, vec(), 0, "clash", 1) for i in range(200)]
    rows += [(7, rows[7][1], 1, "repeat", 1)] * 80  # a hot vector, and repeated keys
    rows += [(300, None, 0, "", 0), (301, [], 0, "", 0), (302, [1.0] * 3, 0, "", 0), (303, [1.0, None, 2.0, 3.0], 0, "", 0), (304, [1.0, float("nan"), 0.0, 0.0], 0, "", 0), (305, [float("-inf")] * 4, 0, "", 0), (None, [0.5] * 4, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k, rounds in ((1, 1), (8, 3), (500, 2)):
        out, final = ce.cluster(df, k=k, rounds=rounds, size=4)
        assert (told(out), final) == brute(rows, k, rounds, 4)
    out, final = ce.cluster(df.where("label > 5"), size=4)
    assert (out.count(), final, out.columns) == (0, [], ["key", "v", "cluster", "distance"])


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(x), 0.0], 0, "", 0) for i, x in enumerate([0, 0, 2, 2, 1, 1, 4, -4])]
    df = spark.createDataFrame(rows, SCHEMA)
    out, final = ce.cluster(df, k=6, rounds=2, size=2)  # two of the first centroids are equal: the later one stays empty
    assert (told(out), final) == brute(rows, 6, 2, 2)
    number, best, _ = ce.Annuli([[3, 4], [-3, -4], [5, 0], [0, 5]]).nearest(np.zeros((1, 2), np.int64), None)
    assert (number[0], best[0]) == (0, 25)  # all on one circle around the vector: the edge of the annulus counts


@pytest.mark.parametrize("seed", range(4))
def test_annulus_is_exact_and_narrow(seed):
    rng = np.random.default_rng(seed)
    cents = (rng.normal(size=(300, 6)) * rng.exponential(100, size=(300, 1))).astype(np.int64)
    x = (rng.normal(size=(500, 6)) * rng.exponential(100, size=(500, 1))).astype(np.int64)
    every = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    first, best, pairs = ce.Annuli(cents.tolist()).nearest(x, None)
    assert (first == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    again, _, fewer = ce.Annuli(cents.tolist()).nearest(x, first)
    assert (again == first).all() and fewer <= pairs < 500 * 300 and fewer < 0.35 * 500 * 300


def test_large_components_are_exact(spark):
    rows = [(i, [float(2.0**e), float(-i)], 0, "", 0) for i, e in enumerate([0, 20, 24, 25, 30, 50, 50])]
    df = spark.createDataFrame(rows, SCHEMA)
    out, final = ce.cluster(df, k=3, rounds=2, size=2)
    want, cents = brute(rows, 3, 2, 2)
    assert told(out) == [(k, v, c, d if d < 2**63 else None) for k, v, c, d in want] and final == cents
    assert ce.cluster(spark.createDataFrame([(1, [1e38, 0.0], 0, "", 0)], SCHEMA), size=2)[0].count() == 0
