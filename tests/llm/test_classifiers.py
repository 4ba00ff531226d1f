"""Quality trees and the toxicity chain: held-out accuracy, defined results."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")]


def toxic(labels):
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


@needs_data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels, toxic(labels))).withColumnRenamed("toxic", "p")
    got = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r.p >= 0.5) == (r.toxic == 1) for r in got]) > 0.93
    assert not [r for r in got if r.p >= 0.5 and r.toxic == 0]


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, 5)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = quality.grow_trees(rows, labels)

    def walk(row):
        total = trees.base
        for column, cut, value in zip(trees.column, trees.cut, trees.value):
            node = 0
            while node < len(column):
                node = 2 * node + (2 if row[column[node]] > cut[node] else 1)
            total += value[node - len(column)]
        return 1 / (1 + np.exp(-total))

    got = trees.score(rows)
    assert np.allclose(got, [walk(r) for r in rows])
    assert ((got >= 0.5) == labels).mean() > 0.95


def test_later_links_of_a_chain_use_earlier_ones():
    """The second category equals the first but has few labels: the first's probability carries it."""
    rng = np.random.default_rng(2)
    rows = (rng.random((900, 30)) < 0.3).astype(np.float32)
    first = (rows[:, 0] + rows[:, 1] > 0).astype(float)
    labels = np.stack([first, np.where(rng.random(900) < 0.3, first, np.nan)], axis=1)
    chain = toxicity.learn_chain(rows, labels, np.arange(900) % 3, ["a", "b"], [str(i) for i in range(30)])
    found = chain.probabilities(rows)
    assert chain.models[1].weight[-1] > 0.3
    assert ((found[:, 1] >= 0.5) == first).mean() > 0.97


def test_odd_documents_and_labels(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(0, 1, 0), (2, 0, None), (4, None, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (7, 1, 0), (7, 1, 0)],
        "doc_id long, quality int, toxic int")
    scored = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(not r.held_out for r in scored if r.doc_id is None)
    by = {r.doc_id: r.score for r in scored if r.doc_id is not None}
    assert by[1] == by[2]
    chain = toxicity.fit(odd, labels, toxic(labels))
    found = toxicity.score(odd, chain).collect()
    assert len(found) == odd.count() and all(0 <= r.toxic <= 1 for r in found)
    empty = labels.limit(0)
    assert {r.score for r in quality.score(odd, quality.fit(odd, empty)).collect()} == {0.5}
    assert {r.toxic for r in toxicity.score(odd, toxicity.fit(odd, empty, toxic(labels))).collect()} == {0.5}
    assert quality.score(nothing, quality.fit(nothing, labels)).count() == 0
    assert toxicity.score(nothing, toxicity.fit(nothing, labels, toxic(labels))).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.fit(docs, labels, max_rows=60).column.shape[1] == 15
    toxicity.fit(docs, labels, toxic(labels), max_rows=60)


def test_keep_good_keeps_columns(odd, nothing):
    flat = quality.Trees(0.0, np.zeros((0, 15), int), np.zeros((0, 15)), np.zeros((0, 16)))
    assert quality.keep_good(odd, flat).columns == odd.columns
    assert quality.keep_good(odd, flat).count() == odd.count() and quality.keep_good(nothing, flat).count() == 0
    assert quality.keep_good(odd, flat, least=0.6).count() == 0
