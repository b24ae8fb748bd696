"""Clusters against a plain version in Python integers; properties of the curve and of the bounds."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from bedside.llm import centroid_clusters as c


def brute(rows, k, rounds, dims, scale):
    kept = [(i, tuple(math.floor(Fraction(x) * scale) if abs(x) * scale == math.inf else math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)) + sorted(("~", v) for i, v in kept if i is None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(members[n]) for x in zip(*members[n])) if n in members else m for n, m in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    short = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return Counter((i, n, short(d), short(inertia[n]), short(sum(inertia.values())), digests[n]) for i, n, d in found)


def run(spark, scratch, rows, **how):
    frame = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id bigint, embedding array<double>, cluster int, distance double")
    return c.cluster(frame, scratch, **how)


def points(rnd, n, dims, spread):
    centers = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centers)]) for i in range(n)]


@pytest.mark.parametrize("spread, largest, rounds", [(0.02, 1, 10), (0.5, 1, 3), (0.1, 3e5, 4), (0.1, 1e12, 3), (0.1, 1e306, 2)])
def test_against_brute_force(spark, scratch, spread, largest, rounds):
    rnd = random.Random(5)
    rows = points(rnd, 700, 4, spread)
    rows += [(9000 + i, [largest * rnd.uniform(-1, 1) for _ in range(4)]) for i in range(3)]
    rows += [(None, [0.0] * 4), (1, None), (2, [None, 0.0, 0.0, 0.0]), (3, [0.0] * 3), (4, []), (5, [math.nan, 0.0, 0.0, 0.0]), (6, [math.inf] * 4), (7, [-math.inf] * 4)]
    rows += [(8000 + i, [0.25] * 4) for i in range(400)] + rows[:20]
    found = run(spark, scratch, rows, k=4, rounds=rounds, dims=4, block=16)
    assert Counter(tuple(r) for r in found.rows.collect()) == brute(rows, 4, rounds, 4, 1024)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark, scratch):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    found = run(spark, scratch, rows, k=6, rounds=5, dims=2)
    assert Counter(tuple(r) for r in found.rows.collect()) == brute(rows, 6, 5, 2, 1024)
    assert len(found.centroids) == 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, -0.5])], [(1, [0.5, 0.1]), (1, [0.5, 0.1]), (1, [0.0, 0.1])]])
def test_few_vectors(spark, scratch, rows):
    found = run(spark, scratch, rows, k=8, rounds=10, dims=2)
    assert Counter(tuple(r) for r in found.rows.collect()) == brute(rows, 8, 10, 2, 1024)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_once_in_steps_of_one(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in c.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_keep_every_nearest_centroid():
    rnd = np.random.default_rng(2)
    spared = 0
    for _ in range(200):
        centroids = [tuple(map(int, rnd.integers(-50, 50, 3))) for _ in range(6)]
        x = rnd.integers(-50, 50, 3) + rnd.integers(-rnd.integers(1, 30), 30, (20, 3))
        at = c.Centroids(centroids)
        left = at.candidates(x.min(0), x.max(0), at.plain)
        distances = ((x[:, None] - np.array(centroids)) ** 2).sum(2)
        assert set(np.nonzero(distances == distances.min(1, keepdims=True))[1]) <= set(left.tolist())
        spared += 6 - len(left)
        for typed in (at.doubles, at.plain, at.exact):
            assert at.candidates(x.min(0), x.max(0), typed).tolist() == left.tolist()
    assert spared > 300


def test_neighbours_share_blocks_and_equal_vectors_spread(spark, scratch):
    rnd = random.Random(8)
    rows = points(rnd, 2000, 8, 0.01) + [(10_000 + i, [0.5] * 8) for i in range(1000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ordered = c.in_hilbert_order(c.kept_vectors(frame, 8), 8)
    sizes = [r["count"] for r in ordered.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert max(sizes) < 1000
    stored = c.blocks(ordered, 8, 1024).collect()
    widths = [int((np.frombuffer(r.high, f"<{r.kind}").astype(int) - np.frombuffer(r.low, f"<{r.kind}").astype(int)).max()) for r in stored]
    assert sorted(widths)[len(widths) // 2] < 300
