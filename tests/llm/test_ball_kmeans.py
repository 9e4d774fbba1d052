"""Ball k-means against comparing every vector with every centroid, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandlake.llm.ball_kmeans import centroid_gaps, cluster_vectors, nearest, reassign


def plain_clusters(rows, k, rounds, seed=2, width=64):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(usable, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in usable]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(usable, found, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), hashes[c]) for (i, _), (d, c) in zip(usable, found, strict=True)]


def check(spark, rows, schema="vec_id long, embedding array<float>", k=6, rounds=3, **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = [tuple(r) for r in cluster_vectors(df.withColumnRenamed("unused", "cluster"), k, rounds, **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain_clusters([r[:2] for r in rows], k, rounds), key=key)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_plain_kmeans(spark, spread):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centres)]) for i in range(300)]
    check(spark, rows)
    check(spark, rows, block_rows=16)


def test_ties_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i % 90, [rng.choice([-0.5, 0.0, 0.25]) if j < 3 else 0.0 for j in range(64)], 1) for i in range(200)]
    bad = [(300, None, 1), (301, [], 1), (302, [1.0] * 63, 1), (303, [1.0] * 65, 1), (304, [None] + [1.0] * 63, 1), (305, [math.nan] + [1.0] * 63, 1), (306, [math.inf] + [1.0] * 63, 1)]
    rows += [*bad, (None, [0.1] * 64, 1), (None, [2.0] * 64, 1), rows[0], rows[0]]
    check(spark, rows, "vec_id long, embedding array<double>, unused int", k=8, rounds=4)
    check(spark, rows[:3] + bad, "vec_id long, embedding array<double>, unused int", k=8)
    check(spark, bad, "vec_id long, embedding array<double>, unused int")
    assert cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_balls_skip_comparisons_and_lose_no_tie():
    rng = np.random.default_rng(1)
    for spread, dims in ((1, 3), (6, 3), (40, 8)):
        centres = rng.integers(-60, 60, (12, dims))
        x = centres[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, dims))
        before = x[:12].copy()
        number, distance = nearest(x, before)
        for moved in (np.ones(12, bool), rng.random(12) < 0.3, np.zeros(12, bool)):
            after = before + moved[:, None] * rng.integers(-3, 4, before.shape)
            got, d, compared = reassign(x, number, distance, after, centroid_gaps(after), moved)
            want, e = nearest(x, after)
            assert (got == want).all() and (d == e).all() and compared < 11 * len(x)
            if not moved.any():
                assert compared == 0


def test_components_too_large_for_exact_distances_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(df).collect()
