"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits. Every window of `SEED` tokens (all
tokens of a shorter item) of a benchmark item is a seed. Documents keep only the windows
that may be seeds: a bitmap of fixed size, whatever the benchmark's, drops nearly all
others where they are read. The survivors are joined to the seeds, which gives the
places that a document and an item share. For each such pair, running Karp-Rabin matching
looks for the longest common passages among the shared places, marks them as tiles that
do not overlap, and goes on with shorter ones down to the seed length. The share of the
item's tokens under tiles is its coverage; the order of the passages plays no part, so a
shuffled item is caught like a verbatim one. A document is contaminated by an item whose
coverage reaches the threshold.

Only shared places are shuffled, never texts. Seeds and token hashes are 64-bit.

Defined results: null and empty texts and items share nothing. Repeated documents are
judged each; repeated items too (a pair of ids gives one row, the highest coverage). Rows
without doc_id are reported with a null one, items without item_id likewise. Empty
tables: no rows. Very long texts are searched whole, a text at a time. Of equally long matches
the one that begins first in the text is marked first. Only doc_id, text and item_id, text are
read, so further columns may have any names; `drop_contaminated` hands them on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.columns import pieces
from bibspark.session import land

SEED, THRESHOLD = 5, 0.8
#: Slots of the bitmap, as a power of two.
SLOTS = 23
#: Token hashes a task remembers.
REMEMBERED = 300_000

_TOKEN = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Token to hash, filled on demand."""

    def __missing__(self, token: str) -> int:
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


def token_hashes(text: str, known: _Hashes) -> np.ndarray:
    tokens = _TOKEN.findall(text.lower())
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _FACTOR + hashes[k : k + n]
        return (out ^ (out >> np.uint64(29))) * _FACTOR


def items_of(benchmark: DataFrame, seed: int = SEED) -> DataFrame:
    """(item, item_id, size, tokens, seeds): each row of `benchmark` as token hashes and seeds."""

    def run(batches):
        part, number, hashes = TaskContext.get().partitionId(), 0, _Hashes()
        for batch in batches:
            rows = [token_hashes(t or "", hashes) for t in batch["text"].to_pylist()]
            seeds = [windows(r, min(seed, len(r))) if len(r) else r for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 33) + number + k for k in range(len(rows))], pa.int64()),
                    batch["item_id"],
                    pa.array([min(seed, len(r)) for r in rows], pa.int32()),
                    pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64())),
                    pa.array([r.view(np.int64) for r in seeds], pa.list_(pa.int64())),
                ],
                ["item", "item_id", "size", "tokens", "seeds"],
            )
            number += len(rows)

    picked = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    schema = "item long, item_id long, size int, tokens array<long>, seeds array<long>"
    return picked.mapInArrow(run, schema).where("size > 0")


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - SLOTS)).astype(np.int64)


def shared_places(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, size, seed, at): windows of documents that may be among `seeds` (size, seed)."""
    slot = F.shiftrightunsigned("seed", 64 - SLOTS)
    # at most 2 ** SLOTS slots for each of at most SEED sizes
    wanted = seeds.select("size", slot.alias("slot")).distinct().toArrow()
    maps: dict[int, np.ndarray] = {}
    for size in set(wanted["size"].to_pylist()):
        mask = np.asarray(wanted["size"]) == size
        maps[size] = np.zeros(1 << SLOTS, bool)
        maps[size][np.asarray(wanted["slot"])[mask]] = True
    packed = {size: np.packbits(m) for size, m in maps.items()}

    def run(batches):
        maps = {size: np.unpackbits(p).view(bool) for size, p in packed.items()}
        part, number, hashes = TaskContext.get().partitionId(), 0, _Hashes()
        for piece in pieces(batches, "text"):
            rows = [token_hashes(t or "", hashes) for t in piece["text"].to_pylist()]
            lengths = np.array([len(r) for r in rows], np.int64)
            every = np.concatenate([*rows, np.zeros(0, np.uint64)])
            begins = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(rows)), lengths)
            for size, known in maps.items():
                found = windows(every, size)
                hit = np.flatnonzero(known[_slot(found)])
                hit = hit[owner[hit] == owner[hit + size - 1]] if len(hit) else hit
                if len(hit):
                    of = owner[hit]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((part << 33) + number + of),
                            piece["doc_id"].take(pa.array(of)),
                            piece["text_hash"].take(pa.array(of)),
                            pa.array(np.full(len(hit), size, np.int32)),
                            pa.array(found[hit].view(np.int64)),
                            pa.array(hit - begins[of]),
                        ],
                        ["row", "doc_id", "text_hash", "size", "seed", "at"],
                    )
            number += len(rows)

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    return picked.mapInArrow(run, "row long, doc_id long, text_hash long, size int, seed long, at long")


def tiles(text: list[int | None], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length) of at least `least` tokens, longest first.

    `None` in `text` matches nothing. Windows of a search length are found by their rolling
    hash and checked token by token; the search length falls by halves to `least`.
    """
    base, prime = 1_000_003, (1 << 61) - 1
    used_text, used_item = [t is None for t in text], [False] * len(item)
    out: list[tuple[int, int, int]] = []

    def free_windows(tokens, used, size):
        """(start, hash) of each window without used tokens, rolled along runs of free ones."""
        value, run, power = 0, 0, pow(base, size - 1, prime)
        for k, token in enumerate(tokens):
            if used[k]:
                value, run = 0, 0
                continue
            if run >= size:
                value = (value - tokens[k - size] * power) % prime
            value, run = (value * base + token) % prime, run + 1
            if run >= size:
                yield k - size + 1, value

    search = max(least, len(item) // 2)
    while True:
        places: dict[int, list[int]] = {}
        for k, value in free_windows(item, used_item, search):
            places.setdefault(value, []).append(k)
        matches = []
        for t, value in free_windows(text, used_text, search):
            for p in places.get(value, ()):
                # only a match's first window counts; later ones are its extension
                if t and p and not used_text[t - 1] and not used_item[p - 1] and text[t - 1] == item[p - 1]:
                    continue
                n = 0
                while (
                    t + n < len(text) and p + n < len(item) and not used_text[t + n] and not used_item[p + n]
                    and text[t + n] == item[p + n]
                ):
                    n += 1
                if n >= search:
                    matches.append((-n, t, p))
        again = False
        for minus, t, p in sorted(matches):
            n = -minus
            if any(used_text[t : t + n]) or any(used_item[p : p + n]):
                again = True  # what is left of it may still be long enough
                continue
            used_text[t : t + n] = [True] * n
            used_item[p : p + n] = [True] * n
            out.append((t, p, n))
        if again:
            continue
        if search == least:
            return out
        search = max(least, search // 2)


def coverage(docs: DataFrame, benchmark: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, text_hash, item_id, n_tokens, n_covered, n_tiles) of every pair that shares a seed."""
    items = land(items_of(benchmark, seed), "benchmark-items")
    seeds = items.select("item", "size", F.posexplode("seeds").alias("of", "seed"))
    places = shared_places(docs, seeds)
    hits = places.join(seeds, ["size", "seed"])
    # bounded by the places that one text and one item share
    pairs = hits.groupBy("row", "doc_id", "text_hash", "item").agg(F.collect_list(F.struct("at", "of")).alias("hits"))
    pairs = pairs.join(items.drop("seeds"), "item")

    def run(batches):
        for batch in batches:
            sizes, covered, counts = [], [], []
            for pair in batch.select(["hits", "size", "tokens"]).to_pylist():
                item, size = pair["tokens"], pair["size"]
                token: dict[int, int] = {}
                for hit in pair["hits"]:
                    for k in range(size):
                        token[hit["at"] + k] = item[hit["of"] + k]
                text: list[int | None] = []
                last = None
                for at in sorted(token):
                    if last is not None and at != last + 1:
                        text.append(None)
                    text.append(token[at])
                    last = at
                found = tiles(text, item, size)
                sizes.append(len(item))
                covered.append(sum(n for _, _, n in found))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("row", "doc_id", "text_hash", "item_id")]
                + [pa.array(x, pa.int32()) for x in (sizes, covered, counts)],
                ["row", "doc_id", "text_hash", "item_id", "n_tokens", "n_covered", "n_tiles"],
            )

    return pairs.mapInArrow(
        run,
        "row long, doc_id long, text_hash long, item_id long, n_tokens int, n_covered int, n_tiles int",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_tokens, n_covered, n_tiles, coverage) of the pairs that reach the threshold."""
    share = F.col("n_covered") / F.col("n_tokens")
    pairs = coverage(docs, benchmark).withColumn("coverage", share).where(F.col("coverage") >= threshold)
    best = F.max(F.struct("coverage", "n_tokens", "n_covered", "n_tiles")).alias("best")
    return pairs.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", "best.n_tokens", "best.n_covered", "best.n_tiles", "best.coverage"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that no item of `benchmark` contaminates.

    The contaminated keys are landed, so that Spark knows their size before it plans the
    join: few are broadcast and the texts stay where they are, many are shuffled.
    """
    bad = contaminated(docs, benchmark, threshold).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")
    )
    bad = land(bad.distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_doc_id"]) & (F.xxhash64(docs["text"]) == bad["_text_hash"])
    return docs.join(bad, same, "left_anti")
