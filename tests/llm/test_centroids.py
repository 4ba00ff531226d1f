"""Centroid clustering against whole-number k-means in Python, and its defined results."""

import hashlib
import math
import random

import pytest

from bibspark.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, v int, near int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2, 3) for i, e in rows], SCHEMA)


def plain(rows, clusters, rounds, size):
    """Rows as (id, vector), in Python whole numbers."""
    points = []
    for i, e in rows:
        if e is None or len(e) != size or any(x is None or not math.isfinite(x) for x in e):
            continue
        points.append((i, [max(-c.BOUND, min(c.BOUND, math.floor(256 * x))) for x in e]))
    rank = lambda p: (p[0] is None, "" if p[0] is None else hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1])
    centres = [p[1] for p in sorted(points, key=rank)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, centre)), k) for k, centre in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centres[k] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *reversed(nearest(v))) for i, v in points]
    total = sum(x[2] for x in found)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centres]
    return sorted(
        [(i, k, d, sum(x[2] for x in found if x[1] == k), total, sha[k]) for i, k, d in found], key=repr
    )


def clustered(spark, rows, clusters, rounds, size):
    got = c.with_inertia(*c.cluster(frame(spark, rows), clusters, rounds, size))
    return sorted([tuple(x) for x in got.collect()], key=repr)


def test_equals_plain_kmeans(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-3.0, 0.0, 2.5]) + rng.random() for _ in range(6)]) for i in range(120)]
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    assert clustered(spark, rows, 7, 5, 6) == plain(rows, 7, 5, 6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [4.0, 4.0]), (None, [2.0, 2.0]), (None, None), (2, None), (3, []), (4, [1.0]),
            (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (9, [2.0**30, -(2.0**30)]), (-7, [0.25, 0.25])]
    for clusters in (1, 3, 40):
        assert clustered(spark, rows, clusters, 3, 2) == plain(rows, clusters, 3, 2)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    same = [(i, [1.0, 1.0]) for i in range(5)]
    found, by_cluster = c.cluster(frame(spark, same), 3, 2, 2)
    assert {x.cluster for x in found.collect()} == {0}
    assert [tuple(x)[:3] for x in by_cluster.collect()] == [(0, 5, 0)]
    between = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]
    assert clustered(spark, between, 2, 0, 2) == plain(between, 2, 0, 2)


def test_no_vectors(spark):
    got = c.with_inertia(*c.cluster(frame(spark, [(1, [1.0])]), 3, 2, 2))
    assert got.count() == 0
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("step", ["moved", "nearest"])
def test_no_python_in_the_plans(spark, step, capsys):
    points = c.whole_vectors(frame(spark, [(1, [1.0, 2.0])]), 2)
    points.select(c.nearest([[1, 2], [3, 4]])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
