"""Vectors dealt to cells: each moves once a paper and cell, results as by plain loops, landed joins without an exchange."""

from collections import defaultdict

import numpy as np
import pytest

from bibspark.operators import features as f
from bibspark.operators import training as tr
from bibspark.session import joined_in_buckets
from tests_data import citing_pairs

PAPERS = 80


@pytest.fixture
def graph(spark, monkeypatch):
    """Edges with repeats, null ends and an end without vector; vectors with a repeated paper. Several cells."""
    monkeypatch.setattr(f, "CELL_BYTES", 256)
    rng = np.random.default_rng(3)
    vecs = [(f"n{i}", rng.normal(size=8).astype("f4").tolist()) for i in range(PAPERS)]
    vecs += [("n1", rng.normal(size=8).astype("f4").tolist()), (None, [1.0] * 8)]
    pairs = citing_pairs(PAPERS)
    pairs += [*pairs[:5], (None, "n1"), ("n2", None), ("gone", "n3"), ("n3", "gone"), ("n1", "n4"), ("n5", "n1")]
    edges = spark.createDataFrame(
        [(a, b, 1 + k % 5, k % 3) for k, (a, b) in enumerate(pairs)], "citing_id string, cited_id string, delta_t int, code int"
    )
    return edges, spark.createDataFrame(vecs, "paper_id string, vector array<float>")


def ends(edges, vectors):
    """(citing, cited, years, code, citing vector, cited vector) of every edge and pair of its ends' rows."""
    by = defaultdict(list)
    for r in vectors.collect():
        if r.paper_id is not None:
            by[r.paper_id].append(np.array(r.vector))
    return [
        (e.citing_id, e.cited_id, e.delta_t, e.code, a, b)
        for e in edges.collect() for a in by[e.citing_id] for b in by[e.cited_id]
    ], by


def test_a_vector_moves_once_a_cell(graph):
    edges, vectors = graph
    cells = f._cells(vectors)
    assert cells == -(-(PAPERS + 2) * 8 * 4 // 256)
    hub = edges.sparkSession.createDataFrame([("n1", f"n{i}") for i in range(60)], "citing_id string, cited_id string")
    rows = f._dealt(hub, vectors.distinct(), 4).collect()
    assert len(rows) == 4 * 2 and sum(len(r["_ends"]) for r in rows) == 60 * 2


def test_landed_factors_are_joined_without_an_exchange(graph, rows):
    edges, vectors = graph
    found = f.interactions(edges, vectors, multiplied=False)
    with joined_in_buckets(found.sparkSession):
        plan = found.where("code > 0").select(*f.FACTORS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    wanted = [tuple(map(repr, (a, b, t, c, x.tolist(), y.tolist()))) for a, b, t, c, x, y in ends(edges, vectors)[0]]
    got = rows(found, "citing_id", "cited_id", "delta_t", "code", *f.FACTORS)
    assert sorted(tuple(map(repr, r)) for r in got) == sorted(wanted)


def test_factors_teach_and_predict_as_features_do(graph):
    edges, vectors = graph
    spark = edges.sparkSession
    odd = vectors.union(spark.createDataFrame([("o1", None), ("o2", [1.0]), ("o3", [None] * 8), ("o4", [float("nan")] * 8)], vectors.schema))
    bad = [(f"o{i}", "n1", 1, 1) for i in (1, 2, 3, 4)] + [("n1", f"o{i}", 1, 1) for i in (1, 2, 3, 4)]
    edges = edges.union(spark.createDataFrame(bad, edges.schema))
    settings = tr.Settings(epochs=4, rate=0.05)
    factors, product = f.interactions(edges, odd, multiplied=False), f.interactions(edges, odd)
    a, log = tr.fit(factors.where("citing_id <> 'o2' and cited_id <> 'o2'"), "code", 3, settings, features=f.FACTORS)
    b, _ = tr.fit(product.where("citing_id <> 'o2' and cited_id <> 'o2'"), "code", 3, settings)
    assert a.size == 8 and log.count() == 4 and np.allclose(a.value, b.value, atol=1e-9)
    one, two = tr.predict(factors.drop("code"), a, f.FACTORS), tr.predict(product.drop("code"), a)
    assert one.where("code is null").count() == two.where("code is null").count() == 2 * 8
    count = lambda df: sorted(map(tuple, df.groupBy("citing_id", "code").count().collect()), key=repr)
    assert count(one) == count(two)


def test_hot_ends_have_the_same_factors(graph, rows):
    edges, vectors = graph
    cool = rows(f.interactions(edges, vectors, multiplied=False), "citing_id", "cited_id", "delta_t", *f.FACTORS)
    edges.sparkSession.conf.set("bibspark.rowsPerTask", "4")
    try:
        hot = rows(f.interactions(edges, vectors, multiplied=False), "citing_id", "cited_id", "delta_t", *f.FACTORS)
    finally:
        edges.sparkSession.conf.unset("bibspark.rowsPerTask")
    assert cool == hot


def test_neighbour_mean_by_cells(graph):
    edges, vectors = graph
    wanted = defaultdict(list)
    by = ends(edges, vectors)[1]
    for e in edges.where("citing_id is not null and cited_id is not null").collect():
        wanted[e.cited_id] += by[e.citing_id]
    means = f.neighbour_mean(edges, vectors)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "aggregate_metrics" not in plan and "SortAggregate" not in plan
    got = {r.paper_id: r.vector for r in means.collect()}
    assert got.keys() == {k for k, v in wanted.items() if v}
    assert all(np.allclose(got[k], np.mean(wanted[k], axis=0)) for k in got)


def test_vectors_of_different_lengths_are_not_summed(graph):
    spark = graph[0].sparkSession
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", [5.0])], "paper_id string, vector array<float>")
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "citing_id string, cited_id string")
    assert {r.paper_id: r.vector for r in f.neighbour_mean(edges, vectors).collect()} == {"x": [2.0, 3.0], "y": [5.0]}
    uneven = edges.union(spark.createDataFrame([("c", "x")], edges.schema))
    with pytest.raises(Exception, match="different lengths"):
        f.neighbour_mean(uneven, vectors).collect()
    assert f.neighbour_mean(edges.limit(0), vectors).count() == 0
    assert f.neighbour_mean(edges, vectors.limit(0)).count() == 0


def test_attention_by_cells(graph):
    edges, vectors = graph
    edges = edges.distinct()
    found, by = ends(edges, vectors)
    score = [(b * a * a).sum() / np.sqrt(8) * np.exp(-0.1 * t) for _, _, t, _, a, b in found]
    sums, total = defaultdict(float), defaultdict(lambda: np.zeros(8))
    for (_, cited, *_), s in zip(found, score):
        sums[cited] += np.exp(s)
    for (citing, cited, *_), s in zip(found, score):
        total[cited] += np.exp(s) / sums[cited] * sum(by[citing])
    att = f.temporal_attention(edges, vectors, 0.1)
    assert att.columns == ["citing_id", "cited_id", "score", "alpha"]
    plan = att._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = sorted((r.citing_id, r.cited_id, round(r.score, 6), round(r.alpha, 6)) for r in att.collect())
    wanted = sorted((a, b, round(s, 6), round(np.exp(s) / sums[b], 6)) for (a, b, *_), s in zip(found, score))
    assert len(got) == len(wanted) and np.allclose([g[2:] for g in got], [w[2:] for w in wanted], atol=2e-6)
    out = {r.paper_id: r.vector for r in f.attention_sum(att, vectors).collect()}
    assert out.keys() == total.keys() and all(np.allclose(out[k], total[k], atol=1e-6) for k in out)


def test_two_models_predict_in_one_pass(graph):
    edges, vectors = graph
    rng = np.random.default_rng(4)
    factors = f.interactions(edges.drop("code"), vectors, multiplied=False)
    intent, flag, other = (tr.DecayModel(c, n, rng.normal(size=c * (n + 1) + 1)) for c, n in ((3, 8), (2, 8), (2, 7)))
    both = f.predict_jointly(factors, intent, flag, f.FACTORS)
    assert both.columns == ["cited_id", "citing_id", "delta_t", "predicted_code", "raw_importance", "predicted_intent"]
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    columns = ["citing_id", "cited_id", "delta_t"]
    one, two = (tr.predict(factors, m, f.FACTORS).orderBy(*columns, "code", "probability").collect() for m in (intent, flag))
    got = both.collect()
    assert sorted((r.citing_id, r.predicted_code) for r in got) == sorted((r.citing_id, r.code) for r in one)
    assert np.allclose(sorted(r.raw_importance for r in got), sorted(r.probability[1] for r in two))
    unfit = f.predict_jointly(factors, intent, other, f.FACTORS).collect()
    assert all(r.raw_importance is None and r.predicted_code is not None for r in unfit)
