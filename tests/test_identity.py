"""Components and author identity against union-find, with chains, hubs, ties, odd names and forced hot keys."""

import random
import re

import pytest

from bibspark.operators import identity as idn
from bibspark.operators.components import components


def smallest(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.fixture(params=[None, "20"])
def hot(spark, request):
    if request.param:
        spark.conf.set("bibspark.rowsPerTask", request.param)
    yield
    spark.conf.unset("bibspark.rowsPerTask")


def found(spark, edges):
    df = components(spark.createDataFrame(edges, "a string, b string"))
    got = df.collect()
    assert len({r.node for r in got}) == len(got)
    return {r.node: r.component for r in got}


def test_components(spark, hot):
    rng = random.Random(3)
    chain = [f"c{i:03}" for i in range(70)]
    order = chain[:]
    rng.shuffle(order)
    edges = list(zip(chain, chain[1:])) + [(order[0], "zz")]
    edges += [("hub", f"leaf{i}") for i in range(60)] + [(f"leaf{i}", "hub") for i in range(9)]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    edges += [("x", "x"), (None, "y"), ("y", None)]
    assert found(spark, edges) == smallest(edges)


def test_no_links(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", "a"), (None, None)]) == {}


def key(name):
    return " ".join(sorted(w for w in re.split(r"[\W_]+", (name or "").lower()) if w))


def test_persons_equal_union_find(spark, hot):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        given, family = f"G{rng.randrange(4)}", f"Ünal{rng.randrange(5)}"
        form = rng.choice([f"{given} {family}", f"{family}, {given}", f"{family.upper()} {given.lower()}."])
        rows.append((f"p{rng.randrange(60)}", f"{rng.choice(['S', 'oa_', 'cr_'])}{rng.randrange(150)}", form))
    rows += [("big", f"S{i}", "One Name") for i in range(200, 240)]  # a block above the task's rows
    rows += rows[:5] + [("p1", "n1", None), ("p1", "n2", None), ("p1", "n3", " .-"), ("p1", "n4", "")]
    rows += [(None, "n5", "One Name"), (None, "n6", "One Name"), ("p1", None, "One Name")]
    blocks, want = {}, {}
    for paper, author, name in rows:
        if author is not None:
            want[author] = author
            if paper is not None and key(name):
                blocks.setdefault((paper, key(name)), []).append(author)
    want |= smallest([(b[0], x) for b in blocks.values() for x in b])
    df = spark.createDataFrame(rows, "paper_id string, author_id string, author_name string")
    people = idn.persons(df)
    got = people.collect()
    assert len(got) == len(want)
    assert {r.author_id: r.person_id for r in got} == want
    assert 1 < len(set(want.values())) < len(want)
    assert {want[f"n{i}"] for i in range(1, 7)} == {f"n{i}" for i in range(1, 7)}

    papers = {(want[a], p) for p, a, _ in rows if a is not None}
    writes = df.where("author_id is not null")
    assert {tuple(r) for r in idn.with_persons(writes, people).collect()} == papers
    report = {r.person_id: r for r in idn.person_report(writes, people).collect()}
    for person in set(want.values()):
        assert report[person].ids == sum(v == person for v in want.values())
        assert report[person].papers == sum(w == person and p is not None for w, p in papers)


def test_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "paper_id string, author_id string, author_name string")
    assert idn.persons(empty).collect() == []
    writes = spark.createDataFrame([("a", "p"), ("a", "p")], "author_id string, paper_id string")
    assert [tuple(r) for r in idn.with_persons(writes, idn.persons(empty)).collect()] == [("a", "p")]


def test_word_order_case_and_punctuation(spark):
    names = spark.createDataFrame([("Ada B. Lovelace",), ("LOVELACE, Ada b",), ("b-ada lovelace",)], "n string")
    assert names.select(idn.name_key(names.n)).distinct().count() == 1


def test_a_name_key_is_made_once_a_row(spark):
    names = ["Lee, Ann", "ann  LEE", "", " - ", None, "\u0130x 9", "\u00bd", "_"]
    rows = spark.createDataFrame([("p", f"a{i}", n) for i, n in enumerate(names)], "paper_id string, author_id string, author_name string")
    rows = rows.union(rows).union(spark.createDataFrame([(None, "b", "Lee"), ("p", None, "Lee")], rows.schema))
    blocks = idn.author_blocks(rows)
    got = {(r.author_id, r.name) for r in blocks.collect()}
    assert got == {("a0", "ann lee"), ("a1", "ann lee"), ("a5", "9 i x"), ("a6", "\u00bd")} and blocks.count() == 4
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split(" in x]
