"""Quality rules by line: a linear-chain conditional random field tells content from boilerplate.

Every line with a word becomes a short row of statistics (lengths, shares of kinds of
characters, repetition within its document). The field scores a labelling of a document's
lines by the weights of the statistics of its content lines and by those of the steps from
one label to the next; Viterbi decoding finds the best labelling. A document stays if no
base rule fails and content lines hold at least `least` of its words.

The labels given are of documents, not of lines, so the field is learned by hard
expectation maximisation on the driver: lines of good documents are content; those of bad
documents start as boilerplate and are then decoded anew by the field found, except that a
bad document in which no line would be boilerplate keeps its lines as they were. Each
round maximises the likelihood of the labellings by gradients from the forward-backward
recursion.

Bounds, all parameters: at most about `max_rows` labelled documents are learned from, above
that an even share by hash of the doc_id; rows whose crc32(doc_id as text) mod 3 is 1 are held
out; a document teaches with its first `max_lines` lines. All documents are judged whole.

Base rules: fewer than LEAST_WORDS words, or more than a fifth of the words within windows of
five words that the text holds twice or more. Counts are of code points and words of the
whole text; words are runs of anything but ASCII white space.

Defined results: a null or empty text, or one without words, has counts of zero, fails the
base rules and is not kept. Very long texts form a piece of their own and are labelled whole,
in time and memory that grow with their length alone. A line without a word has no label. Equally good labels:
content. Repeated rows are judged each, with equal results. A row without doc_id is judged and
keeps its null; it teaches nothing, nor does a doc_id with contradicting or null labels; one
whose rows repeat teaches once. Without usable labels, or with those of one kind, every line
is content, so the base rules decide alone. Empty tables give no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.columns import documents_of, pieces, raw_texts
from bibspark.llm.quality import is_held_out

#: Labelled documents and lines of each that are learned from, at most.
MAX_ROWS, MAX_LINES = 4_000, 256
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
ROUNDS, STEPS, RATE, RIDGE = 3, 120, 0.1, 1e-3

#: Kinds of characters whose shares of a line are statistics.
KINDS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"*#$%&~^+=",
    "stop": b".",
    "comma": b",;:",
    "high": range(128, 256),
}
STATISTICS = [*KINDS, "log_words", "word_length", "seen_before", "repeated_words", "distinct_words", "one"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Lines:
    """Counts of the documents of a piece, and the lines with a word, one after the other."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    rows: np.ndarray  # statistics of each line
    words: np.ndarray  # words of each line
    number: np.ndarray  # the line's place in its document, blank lines counted
    cuts: np.ndarray  # lines of document k: cuts[k] to cuts[k + 1]


def repeated_words(words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of words that their document holds twice or more."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(len(words), bool)
    # exact numbers of windows of 1, 2, 4 words, then of the whole window with its document
    code, have = words.astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        pair = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        code, have = np.unique(pair, return_inverse=True)[1], have + step
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = doc[at] * (int(code.max()) + 1) + code[at]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[where] > 1]
    out = np.zeros(len(words) + 1, np.int64)
    np.add.at(out, twice, 1)
    np.add.at(out, twice + window, -1)
    return np.cumsum(out[:-1]) > 0


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place: a stretch's sum is the difference of two."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _within(running: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return running[ends] - running[begins]


def _count(mask: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many places of `mask` each stretch holds."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, ends) - np.searchsorted(at, begins)


def lines_of(texts: list[bytes]) -> Lines:
    """Counts and line statistics of whole texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_ends = np.cumsum(sizes)
    space = _SPACE[data]
    opens = ~space & np.concatenate([[True], space[:-1]])
    text_begins = text_ends - sizes
    n_words = _count(opens, text_begins, text_ends)
    word_doc = np.repeat(np.arange(len(texts)), n_words)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for t in texts for w in t.split()], np.int64)
    again = _running(repeated_words(codes, word_doc))
    last_word = np.cumsum(n_words)

    line_ends = np.flatnonzero(data == 10) + 1
    line_begins = np.concatenate([[0], line_ends[:-1]])
    line_doc = np.searchsorted(text_ends, line_begins, "right")
    place = np.arange(len(line_ends)) - np.searchsorted(line_doc, line_doc, "left")
    words = _count(opens, line_begins, line_ends)
    full = np.flatnonzero(words > 0)
    line_begins, line_ends, line_doc, words, place = (x[full] for x in (line_begins, line_ends, line_doc, words, place))
    whole = data.tobytes()
    seen_before = np.zeros(len(full), bool)
    seen: set[bytes] = set()
    before = -1
    for k, (d, a, b) in enumerate(zip(line_doc.tolist(), line_begins.tolist(), line_ends.tolist())):
        if d != before:
            seen, before = set(), d
        line = whole[a : b - 1]
        if line in seen:
            seen_before[k] = True
        else:
            seen.add(line)
    word_end = np.cumsum(words)
    word_begin = word_end - words
    bytes_in = _count(~space, line_begins, line_ends)
    rows = np.empty((len(full), len(STATISTICS)), np.float32)
    for k, members in enumerate(KINDS.values()):
        kind = np.zeros(256, bool)
        kind[list(members)] = True
        rows[:, k] = _count(kind[data], line_begins, line_ends) / bytes_in
    # a word is new if its line has not held it: lines and words as one key
    line_of_word = np.repeat(np.arange(len(full)), words)
    new = np.zeros(len(codes), bool)
    new[np.unique(line_of_word * (len(number) + 1) + codes, return_index=True)[1]] = True
    k = len(KINDS)
    rows[:, k] = np.log1p(words)
    rows[:, k + 1] = bytes_in / words
    rows[:, k + 2] = seen_before
    rows[:, k + 3] = _within(again, word_begin, word_end) / words
    rows[:, k + 4] = _within(_running(new), word_begin, word_end) / words
    rows[:, k + 5] = 1
    return Lines(
        n_words,
        _count(~space & ((data & 0xC0) != 0x80), text_begins, text_ends),
        _count(_SYMBOL[data], text_begins, text_ends),
        np.bincount(line_doc[seen_before], minlength=len(texts)),
        _within(again, last_word - n_words, last_word),
        rows,
        words,
        place,
        np.searchsorted(line_doc, np.arange(len(texts) + 1)),
    )


@dataclass(frozen=True)
class Field:
    """Weights of a content line's statistics, of the steps label to label, and of a first content line."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # from label (row) to label (column): 0 boilerplate, 1 content
    first: float

    def lead(self, rows: np.ndarray) -> np.ndarray:
        """How far each line's own score favours content."""
        return ((rows - self.mean) / self.scale) @ self.weights

    def decode(self, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The best labelling of each document's lines, by Viterbi; true: content.

        With two labels it is enough to carry how far the best labelling that ends in
        content leads the best one that ends in boilerplate.
        """
        own = self.lead(rows).tolist()
        (b_b, b_c), (c_b, c_c) = self.steps.tolist()
        labels = [False] * len(own)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == z:
                continue
            lead = own[a] + self.first
            leads = [lead]
            for k in range(a + 1, z):
                lead = own[k] + max(b_c, lead + c_c) - max(b_b, lead + c_b)
                leads.append(lead)
            label = lead >= 0
            labels[z - 1] = label
            for k in range(z - 2, a - 1, -1):
                # the step into the label that follows, from either side
                lead = leads[k - a]
                label = lead + c_c >= b_c if label else lead + c_b >= b_b
                labels[k] = label
        return np.array(labels, bool)


def _by_step(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in descending order of length, and how many have a line at each place."""
    size = np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    return order, np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")


def likelihood(
    rows: np.ndarray, cuts: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: np.ndarray, first: float
) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Log likelihood of the labels, and its gradients for weights, steps and first."""
    own = rows @ weights
    order, width = _by_step(cuts)
    begin = cuts[:-1][order]
    ahead, scores = np.zeros((len(own), 2)), np.zeros((len(own), 2))
    scores[:, 1] = own
    scores[begin, 1] += first
    ahead[begin] = scores[begin]
    for t in range(1, len(width)):
        now = begin[: width[t]] + t
        ahead[now] = scores[now] + np.logaddexp.reduce(ahead[now - 1][:, :, None] + steps, axis=1)
    behind = np.zeros_like(ahead)
    for t in range(len(width) - 1, 0, -1):
        now = begin[: width[t]] + t
        behind[now - 1] = np.logaddexp.reduce(steps + (scores[now] + behind[now])[:, None, :], axis=2)
    ends = cuts[1:][order] - 1
    total = np.logaddexp.reduce(ahead[ends], axis=1)
    by_document = np.zeros(len(cuts) - 1)
    by_document[order] = total
    log_z = np.repeat(by_document, np.diff(cuts))
    p = np.exp(ahead[:, 1] + behind[:, 1] - log_z)
    y = labels.astype(float)
    inner = np.ones(len(own), bool)
    inner[begin] = False
    b = np.flatnonzero(inner)
    pair = np.exp(ahead[b - 1][:, :, None] + steps + (scores[b] + behind[b])[:, None, :] - log_z[b][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[b - 1].astype(int), labels[b].astype(int)), 1)
    value = float((scores[:, 1] * y).sum() + (seen * steps).sum() - total.sum())
    return value, rows.T @ (y - p), seen - pair.sum(axis=0), float((y - p)[begin].sum())


def fit_field(rows: np.ndarray, cuts: np.ndarray, good: np.ndarray) -> Field:
    """The field of lines `rows` of documents that are `good` or not."""
    f = rows.shape[1] if rows.ndim == 2 else len(STATISTICS)
    lengths = np.diff(cuts)
    good_line = np.repeat(good, lengths)
    if not len(good_line) or good_line.all() or not good_line.any():
        return Field(np.zeros(f), np.ones(f), np.zeros(f), np.zeros((2, 2)), 0.0)
    mean, scale = rows.mean(axis=0).astype(float), rows.std(axis=0).astype(float)
    mean[scale == 0], scale[scale == 0] = 0.0, 1.0
    x = (rows - mean) / scale
    labels = good_line.copy()
    theta, known = np.zeros(f + 5), False
    for _ in range(ROUNDS):
        slope, square = np.zeros(f + 5), np.zeros(f + 5)
        for step in range(1, STEPS + 1):
            _, g_weights, g_steps, g_first = likelihood(
                x, cuts, labels, theta[:f], theta[f : f + 4].reshape(2, 2), theta[f + 4]
            )
            gradient = np.concatenate([g_weights, g_steps.ravel(), [g_first]]) / len(x) - RIDGE * theta
            slope = 0.9 * slope + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            theta = theta + RATE * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        field = Field(mean, scale, theta[:f], theta[f : f + 4].reshape(2, 2), float(theta[f + 4]))
        # at first each line by itself: as labelled so far, bad documents have no steps to content
        decoded = field.decode(rows, cuts) if known else field.lead(rows) >= 0
        known = True
        # a bad document has boilerplate somewhere
        some = np.add.reduceat(~decoded, cuts[:-1][lengths > 0]) > 0
        trusted = np.zeros(len(good), bool)
        trusted[lengths > 0] = some
        labels = np.where(good_line, True, np.where(np.repeat(trusted, lengths), decoded, labels))
    return field


def fit(
    docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES
) -> Field:
    """The field learned from at most about `max_rows` rows of `labels` (doc_id, `target`) and their texts."""
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
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale)) < int(share * scale))

    def run(batches):
        for piece in pieces(batches, "text"):
            found = lines_of(raw_texts(piece))
            ends = np.minimum(found.cuts[1:], found.cuts[:-1] + max_lines)
            rows = [found.rows[a:z].ravel().tolist() for a, z in zip(found.cuts[:-1], ends)]
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["label"], pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "label", "rows"]
            )

    # the ids are bounded by max_rows, so the texts stay where they are; a repeated id gives one document
    taught = documents_of(docs).join(F.broadcast(usable), "doc_id").mapInArrow(
        run, "doc_id long, label int, rows array<float>"
    )
    found = taught.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("rows").alias("rows")).toArrow()
    found = found.sort_by("doc_id").combine_chunks() if found.num_rows else found
    rows = [np.array(r, np.float32).reshape(-1, len(STATISTICS)) for r in found["rows"].to_pylist()]
    return fit_field(
        np.concatenate([np.zeros((0, len(STATISTICS)), np.float32), *rows]),
        np.cumsum([0, *map(len, rows)]),
        np.array(found["label"].to_pylist(), int) == 1,
    )


def base_fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judge(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, content_words, boilerplate, kept) for every row of `docs`.

    `boilerplate` holds the numbers, from 0, of the lines labelled so.
    """

    def run(batches):
        for piece in pieces(batches, "text"):
            found = lines_of(raw_texts(piece))
            content = field.decode(found.rows, found.cuts)
            content_words = _within(_running(found.words * content), found.cuts[:-1], found.cuts[1:])
            failed = base_fails(found.n_words, found.n_repeat_words)
            other = np.flatnonzero(~content)
            offsets = np.searchsorted(other, found.cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["doc_id"],
                    *(
                        pa.array(x, pa.int64())
                        for x in (
                            found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines,
                            found.n_repeat_words, content_words,
                        )
                    ),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.number[other], pa.int64())),
                    pa.array(failed),
                    pa.array(~failed & (content_words >= least * found.n_words)),
                ],
                [
                    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words",
                    "boilerplate", "base_failed", "kept",
                ],
            )

    return documents_of(docs).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "content_words long, boilerplate array<long>, base_failed boolean, kept boolean",
    )
