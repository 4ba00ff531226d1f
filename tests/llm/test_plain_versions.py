"""The toxicity chain, tile coverage and flat-file counts of long texts against plain versions."""

import math
import random
import re

import numpy as np
import pytest

from bibspark.llm import decontaminate as dc
from bibspark.llm import token_counts, toxicity
from bibspark.llm.queries import tokenizer_file
from bibspark.llm.tokens import PartEncoder
from bibspark.session import new_path
from tests.llm.test_decontaminate import plain_total


def newton(x, y, steps=40):
    """Weights and bias that minimise the penalised log-loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], toxicity.RIDGE)
    ridge[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        bend = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(ridge + 1e-9)
        w -= np.linalg.solve(bend, slope)
    return w


def penalised_loss(x, y, w, b):
    z = x @ w + b
    return float(np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE / 2 * w @ w)


def test_learning_reaches_the_least_loss():
    rng = np.random.default_rng(1)
    rows = (rng.random((600, 12)) < 0.3).astype(np.float32)
    for odds in (rows[:, 0] * 3 - rows[:, 1] * 2 - 0.5, rows[:, 3] * 1.0 - 4):
        y = (rng.random(600) < 1 / (1 + np.exp(-odds))).astype(float)
        model = toxicity.learn_linear(rows, y)
        x = (rows - model.mean) * model.scale
        best = newton(x, y)
        assert penalised_loss(x, y, model.weight, model.bias) <= penalised_loss(x, y, best[:-1], best[-1]) + 1e-4


def plain_chain(text, chain):
    """Probabilities of one text, word by word and category by category."""
    found = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found |= {word} | {word[:n] + "*" for n in toxicity.BEGINNINGS if len(word) > n}
    row, out = [1.0 if c in found else 0.0 for c in chain.columns], []
    for model in chain.models:
        z = model.bias
        for value, mean, scale, weight in zip(row + out, model.mean, model.scale, model.weight):
            z += (value - mean) * scale * weight
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_chain_scores_equal_a_plain_version(spark, odd):
    rng = random.Random(3)
    bad, fine = ["nasty", "vileness", "awful"], ["river", "stone", "reading", "über", "table4"]
    rows, marks = [], []
    for i in range(300):
        toxic, low = i % 3 == 0, i % 2
        words = rng.choices(fine, k=8) + (rng.choices(bad, k=2) if toxic else []) + (["spam!"] if low else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, {"low": 1 - labels.quality, "toxic": labels.toxic})
    every = docs.unionByName(odd.select("doc_id", "text"))
    # rows without an id or with a repeated one are told apart by their probabilities
    got = sorted((str(r.doc_id), round(r.low, 5), round(r.toxic, 5)) for r in toxicity.score(every, chain).collect())
    want = sorted((str(r.doc_id), *plain_chain(r.text, chain)) for r in every.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=2e-4)
    held = [m for m in toxicity.score(docs, chain).join(labels.withColumnRenamed("toxic", "is"), "doc_id").where("held_out").collect()]
    assert np.mean([(m.toxic >= 0.5) == (m["is"] == 1) for m in held]) > 0.97


@pytest.mark.parametrize("seed", [2, 3, 5])
def test_coverage_equals_the_definition(spark, seed):
    rng = random.Random(seed)
    names = ["red", "fox", "hill", "ran", "sea", "oak", "sky", "ice", "sun", "fen", "bay", "elm"]
    items = [rng.choices(names, k=rng.randrange(1, 22)) for _ in range(12)]
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(5)):
            item = rng.choice(items)
            at = rng.randrange(len(item))
            words += rng.choices(names, k=rng.randrange(4)) + item[at : at + rng.randrange(1, 15)]
        texts.append(words)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(t).upper()) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in dc.coverage(docs, bench, seed).collect()}
    want = {
        (d, i): total
        for d, text in enumerate(texts)
        for i, item in enumerate(items)
        if (total := plain_total(text, item, min(seed, len(item))))
    }
    assert want and got == want


def test_long_texts_cross_many_blocks(spark, odd):
    path, coder = new_path(spark, "flat"), PartEncoder(tokenizer_file())
    token_counts.write(odd.coalesce(1), path, tokenizer_file())
    blocks = token_counts.read_blocks(spark, path, 4096)
    got = sorted(r.n_tokens for r in token_counts.count(blocks).collect())
    assert got == sorted(len(coder.whole(r.text)) // 2 if r.text else 0 for r in odd.collect())
    assert got[-1] > 10 * 4096


def test_the_id_without_a_number_is_refused(spark, odd, monkeypatch):
    few = odd.where("doc_id = 0")
    ids, _ = PartEncoder(tokenizer_file()).encode(few.select("text").toArrow()["text"].combine_chunks())
    # the vocabulary at hand has no id 65,535, so the largest that occurs stands for it
    monkeypatch.setattr(token_counts, "LAST", int(ids.max()))
    with pytest.raises(Exception, match="would read as an end"):
        token_counts.write(few, new_path(spark, "flat"), tokenizer_file())
