"""The title join against all pairs, with common words, repeated titles and forced hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bibspark.operators import titles as ti


def words(title):
    return {w for w in re.split(r"[\W_]+", (title or "").lower()) if w}


def made_up(rng, n, common):
    kinds = ["graph", "net", "deep", "web", "été", "7", "a", "of"]
    rows = [" ".join(([common] if common else []) + rng.choices(kinds, k=rng.randrange(0, 6))) for _ in range(n)]
    return [*rows, None, "", "- -", "Graph, NET!", "graph net"] + ["same title here"] * 5


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
@pytest.mark.parametrize("common", ["", "the"])
def test_equals_all_pairs(spark, least, common):
    rng = random.Random(int(least * 10))
    left, right = made_up(rng, 40, common), made_up(rng, 50, common)
    papers = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(left)], "paper_id string, title string")
    records = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(right)], "record_id string, title string")
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            x, y = words(a), words(b)
            if x and y and len(x & y) / len(x | y) >= least:
                want[f"p{i}", f"r{j}"] = len(x & y) / len(x | y)
    spark.conf.set("bibspark.rowsPerTask", "10")  # every frequent word and title is a hot key
    try:
        got = ti.match_titles(papers, records, least).collect()
    finally:
        spark.conf.unset("bibspark.rowsPerTask")
    assert len(got) == len(want)
    assert {(r.paper_id, r.record_id): r.similarity for r in got} == pytest.approx(want)
    best = {}
    for (p, r), s in sorted(want.items()):
        if p not in best or s > best[p][1]:
            best[p] = (r, s)
    found = ti.best_matches(ti.match_titles(papers, records, least)).collect()
    assert {r.paper_id: r.record_id for r in found} == {p: r for p, (r, _) in best.items()}


def test_hits_are_checked(spark):
    rows = [("p", "Deep nets", "deep NETS."), ("q", "Deep nets", "Deep sea fish"), ("r", None, "x"), ("s", "", "")]
    hits = spark.createDataFrame(rows, "id string, title string, found string")
    assert [r.id for r in ti.accept_hits(hits, "title", "found", 0.5).collect()] == ["p"]
    with pytest.raises(ValueError):
        ti.match_titles(hits, hits, 0)


def test_copies_make_no_pairs_of_rows(spark):
    """2,000 papers and 3,000 records of one title and of a near one: 6 million pairs of rows, four class pairs."""
    n = F.col("id")
    title = F.when(n % 2 == 0, "Deep  graph nets").when(n % 1000 == 1, "deep graph").otherwise("Nets: graph, deep")
    papers = spark.range(2000).select(F.concat(F.lit("p"), n.cast("string")).alias("paper_id"), title.alias("title"))
    records = spark.range(3000).select(F.concat(F.lit("r"), n.cast("string")).alias("record_id"), title.alias("title"))
    odd = spark.createDataFrame([("p0", "graph deep"), ("p9x", "sea"), ("p9y", None), (None, "deep graph")], "paper_id string, title string")
    left, right = ti.title_members(papers.unionByName(odd), "paper_id"), ti.title_members(records, "record_id")
    a, b = ti.title_classes(left, "paper_id"), ti.title_classes(right, "record_id")
    pairs = ti.match_titles(
        a.select(F.col("class").alias("paper_id"), F.col("class").alias("title")),
        b.select(F.col("class").alias("record_id"), F.col("class").alias("title")),
        0.6,
    )
    assert pairs.count() == 4
    got = {(r.paper_id, r.records, r.record_id, round(r.similarity, 6)) for r in ti.class_matches(pairs, left, a, b).collect()}
    every = {r.paper_id: r.title for r in papers.collect()}
    want = {(p, 3000, "r1" if t == "deep graph" else "r0", 1.0) for p, t in every.items()}
    assert got == want | {("p0", 3000, "r1", 1.0), (None, 3000, "r1", 1.0)}
