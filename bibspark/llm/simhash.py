"""Near-duplicates by 64-bit SimHash and covering locality-sensitive hashing.

A text, A-Z lower-cased, gives its shingles of three words; a bit of the fingerprint
is 1 if it is set in over half of the shingles' hashes. Fingerprints link when they
differ in at most `RADIUS` bits. Candidates come from a covering family of masks: the 64
bit places are dealt over the non-zero vectors of RADIUS + 1 bits, and mask v keeps
the places whose vector has odd overlap with v. The at most RADIUS places in which two
linked fingerprints differ span too few dimensions to overlap oddly with every v, so some
mask hides all of them: every linked pair shares a bucket in some table, without exception.

Work goes over distinct fingerprints, never copies. A bucket is first summed up by
count, bounds and the bits that vary in it, which shuffles no lists. Two members are
compared from the summary itself. A bucket of more is not paired up: within it, two
members link exactly if some centre is at most one varying bit away from both (RADIUS
is 2), so each member names its centres, and a centre joins its at most 65 members to
the smallest of them. The work is linear in the fingerprints however full a bucket is.
The links then go through connected components.

Defined results: null and empty texts, and texts of white space, have fingerprint zero
and link like any other; a text of one or two words has one shingle, all its words.
Repeated rows each get a row. Rows without doc_id get a fingerprint and the component
of the documents that link to it, null if there is none; they name no component and
link nobody. Rows that share a doc_id are separate texts. An empty table gives no rows.
Very long texts are hashed whole, a text at a time. Only doc_id and text are read, so
further columns do not matter, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.columns import documents_of, pieces, raw_texts
from bibspark.llm.components import components
from bibspark.session import land

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every three-word shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text; bits of all texts are counted together, eight lanes at a time."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.concatenate([hashes[k] for k in full])
    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # a lane of a byte holds sums up to 255, so texts are summed in runs of at most 255 hashes
    runs = -(-sizes[full] // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    starts = np.repeat(begins, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    counts = np.zeros((len(starts), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((every >> np.uint64(bit)) & _LANES, starts)
        counts[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, BITS), first_run, axis=0)
    bits = (2 * total > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long; with further long columns of its text."""
    names = ["doc_id", *also]

    def run(batches):
        for piece in pieces(batches, "text"):
            fps = fingerprints_of(raw_texts(piece)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[piece[n] for n in names], pa.array(fps)], [*names, "fp"])

    return documents_of(docs).withColumns(also).mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks such that any `radius` places are all hidden by at least one of them."""
    vectors = 2 ** (radius + 1) - 1
    place = [i % vectors + 1 for i in range(bits)]
    return [
        sum(1 << i for i in range(bits) if (place[i] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints `fps` (fp) within the radius."""
    tables = [
        F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for k, m in enumerate(covering_masks())
    ]
    placed = fps.select("fp", F.inline(F.array(*tables)))
    buckets = placed.groupBy("table", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("fp").alias("a"),
        F.max("fp").alias("b"),
        F.bit_and("fp").bitwiseXOR(F.bit_or("fp")).alias("varying"),
    )
    shared = land(buckets.where("n > 1"), "buckets")
    pairs = shared.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    crowded = shared.where("n > 2").select("table", "key", "varying")
    one_bit = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.lit(BITS - 1)),
            lambda i: F.getbit("varying", i) == 1,
        ),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    centres = placed.join(crowded, ["table", "key"]).select(
        "fp", F.explode(F.concat(F.array("fp"), one_bit)).alias("centre")
    )
    # at most 65 distinct fingerprints are within one bit of a centre
    around = centres.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
    stars = around.select(
        F.element_at("near", 1).alias("a"), F.explode(F.slice("near", 2, BITS + 1)).alias("b")
    )
    return pairs.union(stars).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text)."""
    marked = land(fingerprints(docs), "fingerprints")
    first = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = land(first, "distinct-fingerprints")
    linked = components(links(first.select("fp")))
    named = linked.join(first, linked.node == first.fp).groupBy("label").agg(F.min("first").alias("name"))
    of_linked = linked.join(named, "label").select(F.col("node").alias("fp"), "name")
    # landed, so that the last join reads two plain tables and a fingerprint of many copies can be split
    of_all = land(
        first.join(of_linked, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id")),
        "fingerprint-groups",
    )
    return marked.join(of_all, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, nameless: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, without all but one row of each group of linked fingerprints.

    The row with the smallest doc_id stays, of different texts with that doc_id the one
    with the least hash; one row of those alike in both. Rows of one doc_id whose texts
    are not linked are in groups of their own. Rows without doc_id stay, unless `nameless`:
    then they link and are linked like any other, and one of them stays only in a
    group without any doc_id.
    """
    text = F.col("text").cast("string")
    # two hashes of different seeds tell texts apart also among very many rows without an id
    hashes = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}
    taking_part = docs if nameless else docs.where("doc_id is not null")
    marked = land(fingerprints(taking_part, **hashes), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *hashes)
    first = land(marked.groupBy("fp").agg(F.min(row).alias("first")), "distinct-fingerprints")
    linked = components(links(first.select("fp")))
    of_group = first.join(linked, first.fp == linked.node, "left").groupBy(F.coalesce("label", "fp").alias("label"))
    kept = of_group.agg(F.min("first").alias("x")).select("x.doc_id", "x.h1", "x.h2")
    kept = land(kept.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "kept")
    repeated = marked.groupBy("doc_id", *hashes).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = land(repeated.toDF("_id", "_h1", "_h2"), "repeated")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in kept.columns]
    once = kept.alias("a").join(repeated.alias("b"), same, "left_anti")
    several = land(kept.alias("a").join(repeated.alias("b"), same, "left_semi"), "kept-repeated")
    doc = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("long").alias("id"),
        *[h.alias(name) for name, h in hashes.items()],
    )
    of = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("id").eqNullSafe(F.col("_id"))
    out = doc.join(once, of).select("doc.*")
    if several.limit(1).count():
        # rows alike in id and text: combined before the shuffle, however many they are
        one = doc.join(several, of).groupBy("id", "h1", "h2").agg(F.first("doc").alias("doc"))
        out = out.unionByName(one.select("doc.*"))
    return out if nameless else out.unionByName(docs.where("doc_id is null"))
