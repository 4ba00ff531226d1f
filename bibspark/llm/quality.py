"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a short row of statistics (shares of kinds of bytes, repetition
of words and lines, lengths). Trees are grown on the driver from a bounded sample of
labelled rows: values are cut into at most BINS bins once, and each level of a tree
is found from histograms of gradients alone. The finished trees are flattened into
three arrays (column, cut, value of each node of a complete tree), so that a task
walks all trees for a whole batch of rows with array indexing.

Only the text is scored: labels, language, source and ids are never inputs. Rows
whose crc32(doc_id as text) mod 3 is 1 are held out and never learned from. At most
`max_rows` labelled rows are learned from (documented bound); above that, a
hash of the doc_id picks an even share of them. All documents are scored whole.

Defined results: a null text is scored as an empty one. A row without doc_id is
scored but has held_out false. A doc_id with contradicting labels, or null ones,
teaches nothing; one whose rows repeat teaches once. Without usable labels every
score is 0.5, with labels of one kind only it is their smoothed share. Empty tables
give no rows; further columns are ignored, whatever their names. Equal texts get equal
scores. Very long texts are measured whole; of equally good cuts the first is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.columns import documents_of, pieces, raw_texts

#: Labelled rows learned from, at most.
MAX_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 80, 4, 0.15, 10, 1.0

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": b" ",
    "line": b"\n\r",
    "control": [*range(0, 9), 11, 12, *range(14, 32), 127],
    "high": range(128, 256),
    "stop": b".,;:?'\"",
    "shout": b"!",
    "pipe": b"|\t",
    "sign": b"*#$%&~^+=",
    "bracket": b"<>{}[]()",
    "path": b"/\\@_-",
}
STATISTICS = [
    *KINDS,
    "log_bytes",
    "log_words",
    "word_length",
    "distinct_words",
    "twice_in_a_row",
    "most_frequent_word",
    "distinct_pairs",
    "distinct_lines",
    "longest_line",
    "line_words",
    "stops_per_word",
    "words_with_signs",
]

_CLASS = np.zeros((256, len(KINDS)))
for _k, _members in enumerate(KINDS.values()):
    _CLASS[list(_members), _k] = 1.0
_SIGNS = bytes(KINDS["sign"]) + b"!|"


def _statistics_of(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [math.log1p(len(text)), 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    counts = np.bincount(codes)
    twice = int((codes[1:] == codes[:-1]).sum())
    pairs = len(np.unique(codes[1:] * len(number) + codes[:-1])) if n > 1 else 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    signed = sum(int(counts[k]) for w, k in number.items() if w[-1] in _SIGNS)
    return [
        math.log1p(len(text)),
        math.log1p(n),
        sum(map(len, words)) / n,
        len(number) / n,
        twice / n,
        int(counts.max()) / n,
        pairs / max(1, n - 1),
        len(set(lines)) / len(lines),
        max(map(len, lines)) / len(text),
        math.log1p(n / len(lines)),
        text.count(b".") / n,
        signed / n,
    ]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    shares = np.zeros((len(texts), len(KINDS)))
    rest = np.zeros((len(texts), len(STATISTICS) - len(KINDS)))
    for k, text in enumerate(texts):
        if text:
            shares[k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / len(text)
        rest[k] = _statistics_of(text)
    return np.hstack([shares, rest]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth side by side: node k has the children 2k+1 and 2k+2."""

    base: float
    column: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # values up to the cut go left
    value: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees step down one level at a time."""
        total = np.full(len(rows), self.base)
        trees, inner = self.column.shape
        if trees and len(rows):
            node = np.zeros((len(rows), trees), np.int64)
            tree, row = np.arange(trees)[None, :], np.arange(len(rows))[:, None]
            while node[0, 0] < inner:
                node = 2 * node + 1 + (rows[row, self.column[tree, node]] > self.cut[tree, node])
            total = total + self.value[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of bin numbers: column and bin of each inner node, value of each leaf."""
    n, f = codes.shape
    inner = 2**DEPTH - 1
    column, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    node = np.zeros(n, np.int64)
    spread = np.arange(f) * BINS + codes
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        at = ((node - first)[:, None] * (f * BINS) + spread).ravel()
        size = width * f * BINS
        g, h, c = (
            np.bincount(at, np.repeat(w, f), size).reshape(width, f, BINS).cumsum(axis=2)
            for w in (grad, hess, np.ones(n))
        )
        gt, ht, ct = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
        gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(c < LEAST) | (ct - c < LEAST)] = -1.0
        flat = gain.reshape(width, -1)
        best = flat.argmax(axis=1)
        good = flat[np.arange(width), best] > 1e-6
        column[first : first + width] = np.where(good, best // BINS, 0)
        cut[first : first + width] = np.where(good, best % BINS, BINS)
        node = 2 * node + 1 + (codes[np.arange(n), column[node]] > cut[node])
    leaf = node - inner
    top = np.bincount(leaf, grad, inner + 1)
    return column, cut, -RATE * top / (np.bincount(leaf, hess, inner + 1) + RIDGE)


def grow_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for 0/1 `labels` of `rows`, in the order given."""
    ones, n = float(labels.sum()), len(labels)
    inner = 2**DEPTH - 1
    base = math.log((ones + 1) / (n - ones + 1))
    if n == 0 or ones in (0.0, float(n)):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    marks = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(rows.shape[1])]
    codes = np.stack([np.searchsorted(m, rows[:, k], "left") for k, m in enumerate(marks)], axis=1)
    total = np.full(n, base)
    columns, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-total))
        column, cut, value = _grow(codes, p - labels, p * (1 - p))
        node = np.zeros(n, np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (codes[np.arange(n), column[node]] > cut[node])
        total += value[node - inner]
        columns.append(column)
        cuts.append([marks[c][b] if b < len(marks[c]) else np.inf for c, b in zip(column, cut)])
        values.append(value)
    return Trees(base, np.stack(columns), np.array(cuts), np.stack(values))


def is_held_out(doc_id: Column) -> Column:
    """Whether the row may only be judged, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees learned from at most about `max_rows` rows of `labels` (doc_id, `target`) and their texts."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    share = max_rows / max(1, usable.count())
    if share < 1:
        scale = 1 << 30
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < int(share * scale))

    def run(batches):
        for piece in pieces(batches, "text"):
            rows = statistics(raw_texts(piece))
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["label"], pa.array(rows.tolist(), pa.list_(pa.float32()))],
                ["doc_id", "label", "row"],
            )

    # the ids are bounded by max_rows, so the texts stay where they are; a repeated id gives one row
    taught = documents_of(docs).join(F.broadcast(usable), "doc_id").mapInArrow(
        run, "doc_id long, label int, row array<float>"
    )
    found = taught.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("row").alias("row")).toArrow()
    if not found.num_rows:
        return grow_trees(np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0))
    found = found.sort_by("doc_id")
    return grow_trees(
        np.array(found["row"].to_pylist(), np.float32), np.array(found["label"].to_pylist(), float)
    )


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""

    def run(batches):
        for piece in pieces(batches, "text"):
            p = trees.score(statistics(raw_texts(piece)))
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(p)], ["doc_id", "score"])

    return (
        documents_of(docs)
        .mapInArrow(run, "doc_id long, score double")
        .select(
            "doc_id",
            is_held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )


def keep_good(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores `least` or more."""
    position = docs.columns.index("text")

    def run(batches):
        for piece in pieces(batches, position):
            good = trees.score(statistics(raw_texts(piece, position))) >= least
            yield piece.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
