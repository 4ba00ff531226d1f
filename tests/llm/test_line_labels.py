"""Line field: counts, gradient and decoding against their definitions, held-out documents, defined results."""

import itertools
import os
import random
import re

import numpy as np
import pytest

from bibspark.llm import line_labels as l
from bibspark.llm import queries

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain_counts(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if line.split():
            again += line in seen
            seen.add(line)
    n = len(words)
    chars = sum(len(w.decode()) for w in words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return n, chars, len(re.findall(rb"[#*$%&|<>]", data)), again, len(repeated), failed


def made_up(rng):
    words = ["a", "bé", "c#", "漢", "<x>", "\r", "\t", "end.", "two  ", "🙂|"]
    return "".join(rng.choice(words) + rng.choice([" ", "\n", "\n\n", " "]) for _ in range(rng.choice([0, 3, 9, 10, 60, 200])))


def test_counts_by_definition(spark, odd):
    rng = random.Random(1)
    texts = [made_up(rng) for _ in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    nothing_known = l.fit_field(np.zeros((0, 3)), np.zeros(1, int), np.zeros(0, bool))
    field = l.Field(*(np.zeros(len(l.STATISTICS)), np.ones(len(l.STATISTICS)), np.zeros(len(l.STATISTICS))), nothing_known.steps, 0.0)
    got = [
        (x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept)
        for x in l.judge(docs, field).collect()
    ]
    want = [(i, *(c := plain_counts(t)), not c[-1]) for i, t in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def sequences(rng, f=3):
    sizes = [rng.integers(0, 6) for _ in range(12)]
    return rng.normal(size=(sum(sizes), f)), np.cumsum([0, *sizes])


def score(own, steps, first, labels):
    return sum(o for o, y in zip(own, labels) if y) + first * labels[0] + sum(steps[a, b] for a, b in zip(labels, labels[1:]))


def test_decoding_finds_the_best_labelling():
    rng = np.random.default_rng(3)
    rows, cuts = sequences(rng)
    field = l.Field(np.zeros(3), np.ones(3), rng.normal(size=3), rng.normal(size=(2, 2)), 0.3)
    own, got = field.lead(rows), field.decode(rows, cuts)
    for a, z in zip(cuts[:-1], cuts[1:]):
        if a < z:
            all_labels = itertools.product((0, 1), repeat=int(z - a))
            best = max(score(own[a:z], field.steps, 0.3, y) for y in all_labels)
            assert np.isclose(score(own[a:z], field.steps, 0.3, got[a:z].astype(int)), best)


def test_likelihood_and_gradient():
    rng = np.random.default_rng(4)
    rows, cuts = sequences(rng)
    labels = rng.random(len(rows)) < 0.5
    theta = rng.normal(size=3 + 4 + 1)

    def value(x):
        return l.likelihood(rows, cuts, labels, x[:3], x[3:7].reshape(2, 2), x[7])

    plain = 0.0
    own, steps = rows @ theta[:3], theta[3:7].reshape(2, 2)
    for a, z in zip(cuts[:-1], cuts[1:]):
        if a < z:
            sums = [score(own[a:z], steps, theta[7], y) for y in itertools.product((0, 1), repeat=int(z - a))]
            plain += score(own[a:z], steps, theta[7], labels[a:z].astype(int)) - np.logaddexp.reduce(sums)
    found, weights, moves, first = value(theta)
    assert np.isclose(found, plain)
    gradient = np.concatenate([weights, moves.ravel(), [first]])
    for k in range(8):
        shift = np.zeros(8)
        shift[k] = 1e-5
        assert np.isclose(gradient[k], (value(theta + shift)[0] - value(theta - shift)[0]) / 2e-5, atol=1e-4)


@needs_data
def test_held_out_documents(spark):
    """Good held-out documents stay and bad ones go; only the base rules take good ones."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = l.judge(docs, l.fit(docs, labels)).join(labels, "doc_id").where(l.is_held_out(l.F.col("doc_id"))).collect()
    good = [x for x in judged if x.quality == 1 and not x.base_failed]
    bad = [x for x in judged if x.quality == 0]
    assert len(good) > 50 and np.mean([x.kept for x in good]) > 0.97
    assert len(bad) > 5 and np.mean([x.kept for x in bad]) < 0.1
    # within bad documents the field tells lines apart
    assert 0 < sum(x.content_words for x in bad) < sum(x.n_words for x in bad) / 2


def test_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (0, None), (None, 1), (7, 1), (7, 1), (4, 0)], "doc_id long, quality int")
    for taught in (labels, labels.limit(0)):
        field = l.fit(odd, taught)
        got = l.judge(odd, field).collect()
        assert len(got) == odd.count()
        assert not any(x.kept for x in got if x.n_words < 10)
        assert [x.boilerplate for x in got if x.doc_id in (1, 2, 3)] == [[]] * 3
    assert l.judge(nothing, l.fit(nothing, labels)).count() == 0


@needs_data
def test_query_columns(spark):
    got = queries.op12(spark, DATA)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for x in got.collect():
        assert tuple(x)[1:7] == plain_counts(texts[x.doc_id])
