"""One-bit codes: recall against brute force, bounds, defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import neighbours as nb


def exact(vectors, ids, query, k):
    d = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), pytest.approx(float(d[i]))) for i in order]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 150)
    monkeypatch.setattr(nb, "QUERIES", 7)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 32))
    if clustered:
        vectors = rng.normal(size=(6, 32))[rng.integers(0, 6, 900)] * 3 + vectors * 0.2
    vectors = vectors.astype(np.float32)
    ids = rng.permutation(900)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)],
                               "vec_id long, embedding array<float>, score int").repartition(3)
    got = {}
    for r in nb.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(got) == 45
    hits = 0
    for query, found in got.items():
        wanted = exact(vectors.astype(float), ids, query, 10)
        assert sorted(found) == list(range(1, 11))
        hits += len({v for v, _ in found.values()} & {v for v, _ in wanted})
    assert hits >= 0.99 * 450


def test_bounds_spare_most_rows():
    """Clustered vectors: the bounds rule out the other clusters without reading their vectors."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, 256))[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 256)) * 0.05
    centre, turn = vectors.mean(axis=0), nb.rotation(256)
    bits, norms, own = nb.code(vectors, centre, turn)
    assert bits.shape == (4000, 32) and np.allclose(turn @ turn.T, np.eye(256))
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    q = vectors[7] - centre
    estimate = (q @ turn) @ signs.T / 16 / own * norms
    truth = (vectors - centre) @ q
    spread = np.sqrt(1 - own**2) / own * nb.BOUND / np.sqrt(255) * norms * np.linalg.norm(q)
    assert (np.abs(estimate - truth) <= spread).mean() > 0.999


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None),
            (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (10, []),
            (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (300, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, block int")
    got = nb.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [
        (0, 1, 1), (0, 2, 3), (0, 3, 3), (0, 4, 100), (0, 5, 2), (100, 1, 2), (100, 2, 0), (100, 3, 1), (100, 4, 3), (100, 5, 3)]
    assert got[3].score == np.sqrt(2.0)
    assert nb.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert nb.nearest(df, F.lit(False)).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nb.nearest(alone, F.col("vec_id") % 100 == 0).count() == 0


def test_each_row_of_an_id_takes_part(spark):
    """Repeated ids and rows, as candidates and as queries: each query row ranks all rows but itself."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 9.0]), (0, [0.0, 9.0]), (1, [1.0, 1.0]), (1, [0.0, 8.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (3, 10):
        got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nb.nearest(df, F.col("vec_id") == 0, k).collect())
        want = []
        for i, (query, a) in enumerate(rows):
            if query == 0:
                near = sorted((float(np.hypot(a[0] - b[0], a[1] - b[1])), j) for n, (j, b) in enumerate(rows) if n != i)
                want += [(query, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near[:k], 1)]
        assert got == sorted(want)
