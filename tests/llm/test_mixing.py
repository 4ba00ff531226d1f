"""The mix: targets against a plain water level, sampling against its definition, no Python in the plan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bibspark.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, share):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 900, "c": 5, None: 50, "é": 0, "Z": 333}, {"one": 7}, {None: 3, "": 4}, {"x": 0}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "source string, size long"), [3.0, 1.0, 2.0], 1.5).collect()
    wanted = plain_targets(sizes, [3, 1, 2], 1.5) if sum(sizes.values()) else {s: 0.0 for s in sizes}
    assert {r.source: r.target for r in got} == pytest.approx(wanted)
    assert {r.source: r.source_size for r in got} == sizes


def docs_of(spark, n=3000):
    """A third of the rows from one source, sizes from 1 to 97 words."""
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    text = F.expr("array_join(transform(sequence(0, cast(pmod(id * 31, 97) as int)), x -> 'w'), ' ')")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"),
                                 F.lit(1).alias("u"), F.lit(2).alias("p"), F.lit(3).alias("rank"))


def test_takes_the_least_odds_ratios(spark):
    docs = docs_of(spark)
    got = mixing.mix(mixing.sized(docs), [3.0, 1.0, 2.0], 1.5).collect()
    assert len(got) == 3000
    by = {}
    for r in got:
        assert r.copies in (0, 1, 2)
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        rate = rows[0].target / rows[0].source_size
        assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) < 50
        certain = int(rate)
        u = {r.doc_id: (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for r in rows}
        more = sorted([u[r.doc_id] for r in rows if r.copies > certain])
        rest = sorted([u[r.doc_id] for r in rows if r.copies == certain])
        # all but the one document that closes the gap come first in rank
        assert not more or not rest or sum(x > rest[0] for x in more) <= 1
    again = mixing.mix(mixing.sized(docs.repartition(13)), [3.0, 1.0, 2.0], 1.5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_unequal_chances_within_a_source(spark):
    """A scaling column moves documents' chances; words still come near the target."""
    docs = docs_of(spark).withColumn("likes", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25))
    sizes = mixing.sized(docs, "likes")
    aims = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.col("source_size") * 0.3)
    got = mixing.sample(sizes, aims).where("copies > 0").collect()
    even = sum(r.doc_id % 2 == 0 for r in got) / len(got)
    assert 0.65 < even < 0.95


def test_native_and_without_python(spark):
    plan = mixing.mix(mixing.sized(docs_of(spark, 50)), [3.0, 1.0, 2.0], 1.5)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_odd_documents(odd, nothing):
    got = mixing.mix(mixing.sized(odd), [3.0, 1.0, 2.0], 1.5).collect()
    assert len(got) == odd.count() and all(r.copies in (0, 1, 2) for r in got)
    sizes = {r.doc_id: r.size for r in got}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[7] == 20_000
    assert mixing.mix(mixing.sized(nothing), [3.0], 1.5).count() == 0
    repeated = mixing.repeat(odd, [3.0, 1.0, 2.0], 1.5)
    assert repeated.columns == odd.columns and mixing.repeat(nothing, [3.0], 1.5).count() == 0
    taken = sum(r.size * r.copies for r in got)
    assert sum(words(r.text) for r in repeated.collect()) == taken


@pytest.mark.parametrize("texts", [lambda i: f"{i} " * 100, lambda i: "w " * 100])
def test_rows_without_an_id_are_ranked_each_for_itself(spark, texts):
    """400 of 1,000 rows have no id; words come to the target within one document, whether texts differ or not."""
    rows = [(i if i >= 400 else None, texts(i), "s") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(docs), [1.0], 0.505).collect()
    assert len(got) == 1000 and abs(sum(r.size * r.copies for r in got) - 50_500) <= 50
    without = sum(r.copies for r in got if r.doc_id is None)
    assert 150 < without < 250
    again = mixing.mix(mixing.sized(docs.repartition(7)), [1.0], 0.505).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    repeated = mixing.repeat(docs, [1.0], 0.505).collect()
    assert sum(r.doc_id is None for r in repeated) == without
    assert len(repeated) == sum(r.copies for r in got)


def test_one_row_closes_the_gap(spark):
    """Rows of one id and size: 3 of 10 are taken, and one of them more than once where the share asks for it."""
    docs = spark.createDataFrame([(5, f"a b c {i}", "s") for i in range(10)], "doc_id long, text string, source string")
    for share, wanted in ((0.3, 3), (1.1, 11)):
        got = mixing.mix(mixing.sized(docs), [1.0], share).collect()
        assert sum(r.copies for r in got) == wanted
        assert mixing.repeat(docs, [1.0], share).count() == wanted
