"""Toxicity by a chain of linear classifiers.

The categories have an order. Each has a logistic regression over words, and beginnings of
words, that a text holds; every model after the first also sees the probabilities of the
categories before it. While a chain is learned these come from models that have not seen
the row (out-of-fold, FOLDS folds by a hash of the doc_id), so a later model learns how far an
earlier one can be trusted; when texts are scored they come from the models of all rows.

Learning uses a bounded sample: at most about `max_rows` labelled rows, an even share by a
hash of the doc_id, without the held-out third (see `quality`). Spark counts, over the
sample, how many texts of each label hold a feature; the COLUMNS features whose presence
says most about any category become the columns, and only a bit for each row and column
comes to the driver. All documents are scored whole, where they are read.

Defined results: null and empty texts hold no feature and get the score of such a text. A
label that is null is not learned from, for its category only; contradicting labels of
a doc_id teach nothing, repeated rows teach once. A category without both kinds of labels
gets their smoothed share, 0.5 without any. Rows without doc_id are scored, held_out
false. Repeated rows are scored each. Very long texts are scored whole: a feature counts once,
however often a text has it. Of equally telling features the alphabetically first become columns.
Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.columns import documents_of, pieces
from bibspark.llm.quality import is_held_out
from bibspark.session import land

#: Labelled rows learned from, at most; columns; folds.
MAX_ROWS, COLUMNS, FOLDS = 10_000, 512, 3
STEPS, RIDGE = 200, 2e-3
BEGINNINGS = (4, 5)
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class _Columns(dict):
    """Word to the columns of its features, filled on demand."""

    def __init__(self, names: list[str]):
        self.at = {name: k for k, name in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = self[word] = tuple(self.at[f] for f in features(word) if f in self.at)
        return value

    def rows(self, texts: list[str]) -> np.ndarray:
        """A row of 0 and 1 for each text."""
        out = np.zeros((len(texts), len(self.at)), np.float32)
        for k, text in enumerate(texts):
            out[k, list({c for found in map(self.__getitem__, words_of(text)) for c in found})] = 1
        if len(self) > REMEMBERED:
            self.clear()
        return out


@dataclass(frozen=True)
class Linear:
    """A logistic regression over columns that are first centred and scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(((rows - self.mean) * self.scale) @ self.weight + self.bias)))


def learn_linear(rows: np.ndarray, labels: np.ndarray) -> Linear:
    """Accelerated gradient steps on the penalised log-likelihood; a constant where labels do not differ."""
    f, n, ones = rows.shape[1], len(labels), float(labels.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0.0, float(n)):
        return Linear(np.zeros(f), np.ones(f), np.zeros(f), base)
    mean = rows.mean(axis=0)
    spread = rows.std(axis=0)
    scale = np.where(spread > 0, 1 / np.maximum(spread, 0.02), 0.0)
    x = ((rows - mean) * scale).astype(np.float32)
    # the largest eigenvalue of x'x/n, by power steps, sets the step
    v = np.ones(f, np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * (float(np.linalg.norm(x @ v)) ** 2 / n + 1) + RIDGE)
    w, b = np.zeros(f, np.float32), base
    look_w, look_b, pace = w, b, 1.0
    for _ in range(STEPS):
        gap = (1 / (1 + np.exp(-(x @ look_w + look_b))) - labels).astype(np.float32)
        new_w = look_w - step * (x.T @ gap / n + RIDGE * look_w)
        new_b = look_b - step * float(gap.mean())
        new_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        push = (pace - 1) / new_pace
        look_w, look_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b, pace = new_w, new_b, new_pace
    return Linear(mean, scale, w.astype(float), float(b))


@dataclass(frozen=True)
class Chain:
    categories: list[str]
    columns: list[str]
    models: list[Linear]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """A column for each category; each model sees the columns before its own."""
        before = np.zeros((len(rows), 0))
        for model in self.models:
            own = model.probability(np.hstack([rows, before]))
            before = np.hstack([before, own[:, None]])
        return before


def learn_chain(rows: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: list[str], columns) -> Chain:
    """The chain for `labels`, a column a category, nan where unknown."""
    before, models = np.zeros((len(rows), 0)), []
    for k in range(len(categories)):
        x, y = np.hstack([rows, before]), labels[:, k]
        known = ~np.isnan(y)
        models.append(learn_linear(x[known], y[known]))
        own = np.zeros(len(rows))
        if k + 1 < len(categories):
            for fold in range(FOLDS):
                inside = folds == fold
                own[inside] = learn_linear(x[known & ~inside], y[known & ~inside]).probability(x[inside])
        before = np.hstack([before, own[:, None]])
    return Chain(categories, list(columns), models)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS) -> Chain:
    """A chain for `categories`, named 0/1 columns of `labels` (doc_id, ...), in their order."""
    names = list(categories)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    agree = [F.when(F.min(n) == F.max(n), F.min(n)).alias(n) for n in names]
    usable = (
        given.where("doc_id is not null")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(*agree)
        .where(F.coalesce(*names).isNotNull())
    )
    share = max_rows / max(1, usable.count())
    if share < 1:
        scale = 1 << 30
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale)) < int(share * scale))

    def held(batches):
        for piece in pieces(batches, "text"):
            found = [sorted(words_of(t or "")) for t in piece["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(found, pa.list_(pa.string()))], ["doc_id", "words"])

    # max_rows bounds the ids, so the texts stay where they are; a repeated id gives one row
    texts = documents_of(docs).join(F.broadcast(usable.select("doc_id")), "doc_id").mapInArrow(
        held, "doc_id long, words array<string>"
    )
    sample = land(texts.groupBy("doc_id").agg(F.min("words").alias("words")).join(usable, "doc_id"), "labelled-words")
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_ones") for n in names]
    counts = [F.count(n).alias(f"{n}_all") for n in names]
    total = sample.agg(*sums, *counts).collect()[0]
    made = [F.col("word"), *[F.concat(F.substring("word", 1, n), F.lit("*")) for n in BEGINNINGS]]
    kept = [F.lit(True), *[F.length("word") > n for n in BEGINNINGS]]
    each = sample.select("doc_id", *names, F.explode("words").alias("word")).select(
        "doc_id", *names, F.explode(F.array(*[F.when(k, m) for m, k in zip(made, kept)])).alias("feature")
    )
    present = each.where("feature is not null").distinct().groupBy("feature").agg(*sums, *counts)

    def says(name: str) -> Column:
        ones, n = total[f"{name}_ones"], total[f"{name}_all"]
        expected = F.col(f"{name}_all") * (ones / max(1, n))
        return F.pow(F.col(f"{name}_ones") - expected, 2) / (expected * (1 - ones / max(1, n)) + 1)

    best = present.select("feature", F.greatest(*[says(n) for n in names], F.lit(0.0)).alias("says"))
    columns = [r["feature"] for r in best.orderBy(F.desc("says"), "feature").limit(COLUMNS).collect()]

    def bits(batches):
        at = _Columns(columns)
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(columns)), np.uint8)
            for k, words in enumerate(batch["words"].to_pylist()):
                rows[k, list({c for w in words for c in at[w]})] = 1
            packed = np.packbits(rows, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([p.tobytes() for p in packed], pa.binary()), *[batch[n] for n in names]],
                ["doc_id", "bits", *names],
            )

    schema = "doc_id long, bits binary, " + ", ".join(f"`{n}` int" for n in names)
    found = sample.mapInArrow(bits, schema).toArrow().sort_by("doc_id")
    width = -(-len(columns) // 8)
    packed = np.frombuffer(b"".join(found["bits"].to_pylist()), np.uint8).reshape(found.num_rows, width)
    rows = np.unpackbits(packed, axis=1, count=len(columns)).astype(np.float32)
    marks = np.array([[np.nan if v is None else v for v in found[n].to_pylist()] for n in names], float).T
    ids = np.asarray(found["doc_id"], np.int64)
    folds = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS
    return learn_chain(rows, marks.reshape(len(ids), len(names)), folds, names, columns)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, held_out, a probability for each category) for every row of `docs`."""
    schema = "doc_id long, " + ", ".join(f"`{n}` double" for n in chain.categories)

    def run(batches):
        at = _Columns(chain.columns)
        for piece in pieces(batches, "text"):
            found = chain.probabilities(at.rows([t or "" for t in piece["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], *[pa.array(c) for c in found.T]], ["doc_id", *chain.categories]
            )

    return documents_of(docs).mapInArrow(run, schema).withColumn("held_out", is_held_out(F.col("doc_id")))
