"""Hirsch indexes, weights and rankings."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.operators import metrics as m


def brute_h(values):
    """By definition: the greatest i such that at least i of the values are i or more."""
    return float(max(i for i in range(len(values) + 1) if sum(v >= i for v in values) >= i))


@pytest.mark.parametrize("values, h", [([0.9], 0), ([3.5, 2.0, 2.9, 0.2], 2), ([5] * 5, 5), ([0, 0], 0),
                                       ([1, 1, 1], 1), ([2.9999999999999, 3, 3], 3), ([1e9], 1)])
def test_hirsch_examples(spark, values, h):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, x double")
    assert m.hirsch(df, "g", {"h": "x"}).first().h == h


def test_hirsch_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert m.hirsch(df, "g", {"h": "x"}).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.floats(0, 20)), min_size=1, max_size=60))
def test_hirsch_equals_the_definition(spark, data):
    df = spark.createDataFrame(data, "g string, x double")
    wanted = {g: brute_h([round(x, 9) for gg, x in data if gg == g]) for g, _ in data}
    fast = m.hirsch(df, "g", {"h": "x", "same": "x"}, count_as="n").collect()
    assert {r.g: r.h for r in fast} == wanted and all(r.h == r.same for r in fast)
    assert {r.g: r.n for r in fast} == {g: sum(1 for gg, _ in data if gg == g) for g in wanted}
    for r in fast:
        assert r.h <= r.n and r.h <= max(x for g, x in data if g == r.g) + 1e-6


EDGES = [("c1", "p", "Method", 1), ("c2", "p", "Result", 2), ("c3", "p", "Background", 30),
         ("d1", "c1", "Method", 1), ("d2", "c1", "Method", 1), ("d3", "c1", "Odd", 1), ("d1", "c2", "Result", 3)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "citing_id string, cited_id string, intent string, delta_t int")


def brute_ranking(edges, writes, lam):
    w = {"Background": 0.5, "Method": 1.5, "Result": 1.2}
    s, raw = {}, {}
    for _, d, i, t in edges:
        raw[d] = raw.get(d, 0) + 1
        s[d] = s.get(d, 0.0) + (w[i] * math.exp(-lam * t) if i in w else 0.0)
    papers = {d for _, d, _, _ in edges}
    h = {p: brute_h([raw.get(c, 0) for c, d, _, _ in edges if d == p]) for p in papers}
    sh = {p: brute_h([s.get(c, 0.0) for c, d, _, _ in edges if d == p]) for p in papers}
    n = {}
    for _, p in writes:
        n[p] = n.get(p, 0) + 1
    out = {}
    for a in {a for a, _ in writes}:
        mine = [p for aa, p in writes if aa == a]
        normal = brute_h([h.get(p, 0) / n[p] for p in mine])
        if normal > 0:
            out[a] = (len(mine), normal, brute_h([sh.get(p, 0) / n[p] for p in mine]))
    return out


def test_hp_frac_against_loops(spark, edges):
    writes = [("A", "p"), ("B", "c1"), ("B", "zzz"), ("C", "c2"), ("A", "c2"), ("A", "c2")]
    got = m.hp_frac(m.weigh_edges(edges, 0.1), spark.createDataFrame(writes, "author_id string, paper_id string"))
    got = {r.author_id: (r.total_papers, r.normal_hp_frac, r.semantic_hp_frac) for r in got.collect()}
    assert got == brute_ranking(EDGES, writes, 0.1)


def test_unknown_intent_has_no_multiplier(edges):
    odd = m.weigh_edges(edges, 0.1).where("intent = 'Odd'").first()
    assert odd.intent_multiplier is None and odd.semantic_weight is None
    scores = {r.paper_id: r for r in m.cited_scores(m.weigh_edges(edges, 0.1)).collect()}
    assert scores["c1"].raw == 3 and scores["c1"].s_c == pytest.approx(3.0 * math.exp(-0.1))


def test_uncited_papers_score_zero(spark, edges):
    papers = spark.createDataFrame([("p",), ("alone",)], "paper_id string")
    got = {r.paper_id: (r.s_c, r.raw) for r in m.paper_scores(papers, m.weigh_edges(edges, 0.1)).collect()}
    assert got["alone"] == (0.0, 0) and got["p"][1] == 3


def test_splitting_hot_keys_keeps_the_ranking(spark, rows):
    pairs = [(f"x{i}", f"x{j}", ["Method", "Result", "Background"][(i + j) % 3], 1 + i % 4)
             for i in range(40) for j in range(i) if (i * j) % 3 != 1]
    edges = m.weigh_edges(spark.createDataFrame(pairs, "citing_id string, cited_id string, intent string, delta_t int"), 0.1)
    writes = spark.createDataFrame([(f"a{i % 4}", f"x{i}") for i in range(40)], "author_id string, paper_id string")
    wanted, raw = rows(m.hp_frac(edges, writes)), rows(m.hp_frac_raw(edges, writes))
    sizes = rows(m.relative_importance(edges))
    spark.conf.set("bibspark.rowsPerTask", "2")
    try:
        assert rows(m.hp_frac(edges, writes)) == wanted
        assert rows(m.hp_frac_raw(edges, writes)) == raw
        assert rows(m.relative_importance(edges)) == sizes
    finally:
        spark.conf.unset("bibspark.rowsPerTask")


def test_edge_scores_equal_the_joined_form(spark, edges, rows):
    weighted = edges.withColumn("semantic_weight", F.col("delta_t") / 10)
    joined = (m.relative_importance(weighted)
              .withColumn("x", F.col("relative_importance") * m.intent_multiplier(F.col("intent"), m.EVALUATION))
              .groupBy("cited_id").agg(F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 6)))
    assert rows(joined) == rows(m.edge_scores(weighted).select("paper_id", F.round("semantic_citations", 6)))


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 9, 10, 99)], "x double")
    clipped = [r["count"] for r in m.histogram(df, "x", bins=10, clip=10.0).orderBy("bin").collect()]
    assert clipped == [1, 2, 0, 0, 0, 0, 0, 0, 0, 3]
    assert sum(r["count"] for r in m.histogram(df, "x", bins=7).collect()) == 6
    flat = m.histogram(df.where("x = 1"), "x", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [2, 0, 0]


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, x double")
    got = m.influence_share(df, ["x"])
    assert sorted(r.x_percent for r in got.collect()) == [25.0, 75.0]


def test_columns_are_found_by_alias():
    assert m.resolve_columns(["source_paper_id", "author_names"], m.META_ALIASES) == {
        "id": "source_paper_id", "authors": "author_names"}
    with pytest.raises(ValueError, match="authors"):
        m.resolve_columns(["paper_id"], m.META_ALIASES)


def test_author_fractional_sum(spark):
    scores = spark.createDataFrame([("p", 4, 6.0), ("q", 1, 0.5)], "paper_id string, raw_citations int, semantic_citations double")
    authors = spark.createDataFrame(
        [("p", 0, "1", "Ann"), ("p", 1, None, "No Id"), ("q", 0, "1", "Ann B"), ("q", 1, "2", None)],
        "paper_id string, position int, author_id string, author_name string")
    got = {r.author_id: r for r in m.author_fractional_sum(scores, authors).collect()}
    assert got["1"].author_name == "Ann B" and got["1"].normal == 2.5 and got["1"].semantic == 3.25
    assert got["1"].h_index == 1 and got["2"].author_name == "Author_2"


def test_impact_by_name_splits_and_strips(spark, rows):
    df = spark.createDataFrame([("p", "Ann Cole , Bo Day", 1.0, 2), ("q", "Bo Day,X", 2.0, 3)],
                               "paper_id string, authors string, total_semantic_impact double, raw_citation_count int")
    assert rows(m.author_impact_by_name(df)) == [("Ann Cole", 1.0, 2, 1), ("Bo Day", 3.0, 5, 2)]
