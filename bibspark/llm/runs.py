"""Periodic runs of words: harmonic grids driven by difference-cover extensions.

A run is a stretch of consecutive words of one document with smallest period q (words q apart
are identical) and a length of at least max(least, 2q) that no neighbouring word extends. Any
such stretch holds two places i and i + q with i a multiple of q, so for every q only the
places of a grid of step q are looked at: n + n/2 + n/3 + ... places in all. Where the two
words of a place agree, the longest common extensions of (i, i + q) to both sides give the
stretch; it is taken at its leftmost grid place.

Extensions come from a sparse index. With a difference cover modulo v, any two places reach,
within fewer than v words, a pair of places that are both in the cover. Only suffixes that
start at covered places are sorted (first by v words, then by doubling the blocks, groups
of one left out), the common prefixes of neighbours are read off the kept ranks of the
doublings, and a sparse table answers the minimum between any two. The index is built
once for each direction, and only for documents in which some place agrees over v words or
more; all others are settled by comparing those few words.

A task takes whole documents in pieces of some 4 MB of text, so nothing is shuffled, and
no document needs another. A document is worked on in memory as a whole: about 60 bytes a
word beyond the text.

Defined results: a null text, or one without words, has no words, no runs and an empty
collapsed text. Very long texts form a piece of their own and are taken whole. Rows are
worked on each for itself, so repeated rows repeat their result. A row without doc_id
keeps its null. Stretches that hold with several periods count once, with the smallest.
Empty tables give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bibspark.llm.columns import documents_of, pieces, raw_texts

#: Shortest run, in words.
LEAST = 12
#: Perfect difference sets; every difference modulo the key occurs once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
MODULUS = 13
#: Grid places extended at once.
CHUNK = 1 << 19
#: Stands before, between and after documents; words are numbered from 1.
GAP = 0


class CommonExtensions:
    """Longest common extensions to the right of two places of one document.

    `words` are word numbers with a GAP after each document, `doc` the document of every
    place (a GAP belongs to the document before it), in ascending order.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, modulus: int = MODULUS):
        v = self.v = modulus
        cover = np.array(COVERS[v])
        self.words = np.concatenate([words, np.full(v, GAP, words.dtype)])
        self.place = np.full(v, -1)
        self.place[cover] = np.arange(len(cover))
        self.per = len(cover)
        # shift[a, b]: words from places of residues a and b to the next pair in the cover
        self.shift = np.zeros((v, v), np.int64)
        for a in range(v):
            for b in range(v):
                self.shift[a, b] = min(k for k in range(v) if self.place[(a + k) % v] >= 0 and self.place[(b + k) % v] >= 0)
        at = (np.arange(0, len(words) + v, v)[:, None] + cover).ravel()
        at = at[at < len(words)]
        self._sort(at, doc[at])

    def _sample(self, places: np.ndarray) -> np.ndarray:
        return places // self.v * self.per + self.place[places % self.v]

    def _sort(self, at: np.ndarray, doc: np.ndarray) -> None:
        m, v = len(at), self.v
        # rank of a group: the number of suffixes before it
        rank = np.searchsorted(doc, doc, "left")
        active = np.arange(m)

        def refine(values: np.ndarray, width: int) -> None:
            nonlocal active
            key = rank[active] * width + values
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            group, k = rank[active], np.arange(len(active))
            first = np.concatenate([[True], key[1:] != key[:-1]])
            opens = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.maximum.accumulate(np.where(first, k, 0))
            rank[active] = group + start - np.maximum.accumulate(np.where(opens, k, 0))
            alone = first & np.concatenate([first[1:], [True]])
            active = active[~alone]

        width = int(self.words.max(initial=0)) + 1
        packed = max(1, (62 - m.bit_length()) // width.bit_length())
        for t in range(0, v, packed):
            if not len(active):
                break
            values = np.zeros(len(active), np.int64)
            for k in range(t, min(v, t + packed)):
                values = values * width + self.words[at[active] + k]
            refine(values, width ** (min(v, t + packed) - t))
        levels, block = [rank.copy()], v
        while len(active):
            # blocks of an active suffix equal another's of its document, so they end within it
            refine(levels[-1][self._sample(at[active] + block)], m)
            levels.append(rank.copy())
            block *= 2
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        same = doc[order[1:]] == doc[order[:-1]]
        a, b = at[order[:-1]][same], at[order[1:]][same]
        length = np.zeros(len(a), np.int64)
        for level in reversed(levels):
            equal = level[self._sample(a + length)] == level[self._sample(b + length)]
            length[equal] += block
            block //= 2
        length += common_words(self.words, a + length, b + length, np.full(len(a), v), 1)
        lcp = np.zeros(m, np.int32)
        lcp[1:][same] = length
        self.table, span = [lcp], 1
        most = int(np.diff(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))).max(initial=0))
        while 2 * span <= most:
            low = self.table[-1].copy()
            low[:-span] = np.minimum(low[:-span], low[span:])
            self.table.append(low)
            span *= 2
        self.table = np.stack(self.table)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, for places i != j of one document each."""
        k = self.shift[i % self.v, j % self.v]
        length = common_words(self.words, i, j, k, 1)
        rest = np.flatnonzero(length == k)
        a, b = (self.rank[self._sample(x[rest] + k[rest])] for x in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        length[rest] += np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1])
        return length


def common_words(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Words that agree from i and j on in direction `step`, `most` at most."""
    length = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        by = length[left] * step
        left = left[words[i[left] + by] == words[j[left] + by]]
        length[left] += 1
        left = left[length[left] < most[left]]
    return length


def _grid(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) of all grid places whose words agree; documents stand in descending order of size."""
    found, total = [], 0
    for q in range(1, int(sizes.max(initial=0)) // 2 + 1):
        fit = int(np.searchsorted(-sizes, -2 * q, "right"))
        end = ends[fit - 1]
        i = np.flatnonzero(words[0 : end - q : q] == words[q:end:q]) * q
        i = i[(words[i] != GAP) & (doc[i] == doc[i + q])]
        if len(i):
            found.append((i, np.full(len(i), q)))
            total += len(i)
            if total >= CHUNK:
                yield tuple(map(np.concatenate, zip(*found)))
                found, total = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def _layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with gaps around them, the document of each place (the leading gap is of none), ends of documents."""
    gap = np.full(1, GAP, np.int32)
    words = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    doc = np.repeat(np.arange(-1, len(texts)), [1, *[len(t) + 1 for t in texts]])
    return words, doc, np.cumsum([1, *[len(t) + 1 for t in texts]])[1:] - 1


def find(texts: list[np.ndarray], least: int = LEAST, modulus: int = MODULUS) -> list[np.ndarray]:
    """Runs (start, length, period) of each text of word numbers (1 and up), by start, then period."""
    size = np.array([len(t) for t in texts], np.int64)
    by_size = np.argsort(-size, kind="stable")
    by_size = by_size[size[by_size] >= least]
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    if not len(by_size):
        return out
    wanted, found = by_size, []
    for extend in (False, True):
        # first a few words only; then the documents in which these agree throughout, by the index
        words, doc, ends = _layout([texts[k] for k in wanted])
        more = np.zeros(len(wanted), bool)
        if extend:
            last = len(words) - 1
            right = CommonExtensions(words, doc, modulus)
            mirrored = np.where(words == GAP, doc + 1, doc)[::-1]
            left = CommonExtensions(words[::-1].copy(), len(wanted) - mirrored, modulus)
        for i, q in _grid(words, doc, ends, size[wanted]):
            if extend:
                ahead = right(i, i + q)
                behind = left(last - i + 1, last - i - q + 1)
            else:
                most = np.full(len(i), modulus)
                ahead = common_words(words, i, i + q, most, 1)
                behind = common_words(words, i - 1, i + q - 1, np.minimum(most, q), -1)
                more[doc[i[((ahead == modulus) | (behind == modulus)) & (behind < q)]]] = True
            # at the leftmost grid place of a run, less than a period lies before it
            good = (behind < q) & (ahead + behind >= np.maximum(q, least - q))
            i, q, ahead, behind = i[good], q[good], ahead[good], behind[good]
            opens = np.concatenate([[1], ends[:-1] + 1])
            found.append(np.stack([wanted[doc[i]], i - behind - opens[doc[i]], ahead + behind + q, q], axis=1))
        if not extend:
            again = np.zeros(len(texts), bool)
            again[wanted[more]] = True
            found = [x[~again[x[:, 0]]] for x in found]
            wanted = wanted[more]
            if not len(wanted):
                break
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # one stretch with several periods: the smallest stands first
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    for k in by_size:
        out[k] = runs[cuts[k] : cuts[k + 1], 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    rewrite: Callable[[int | None, int], np.ndarray | None] | None = None,
    modulus: int = MODULUS,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of `docs`.

    `runs` are (start, length, period) in words by start, then period; `collapsed` holds
    the UTF-8 bytes of the kept words with single spaces between. `rewrite(doc_id, n)` may
    name the n places whose words a document is made of instead of its own order.
    """
    place = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for piece in pieces(batches, "text"):
            number: dict[bytes, int] = {}
            texts, words = [], [text.split() for text in raw_texts(piece)]
            for k, (doc_id, own) in enumerate(zip(piece["doc_id"].to_pylist(), words)):
                order = rewrite(doc_id, len(own)) if rewrite is not None else None
                if order is not None:
                    words[k] = own = [own[x] for x in order.tolist()]
                texts.append(np.array([number.setdefault(w, len(number) + 1) for w in own], np.int32))
            runs = find(texts, least, modulus)
            collapsed = [
                b" ".join(compress(own, kept_words(len(own), r).tolist()) if len(r) else own) for own, r in zip(words, runs)
            ]
            flat = np.concatenate(runs)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(place)),
            )
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], pa.array(list(map(len, words)), pa.int64()), lists, pa.array(collapsed, pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents_of(docs).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    )
