"""SimHash groups against brute force."""

import itertools
import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bibspark.llm import simhash
from bibspark.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if words and not shingles:
        shingles = [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """node -> smallest node reachable, by union-find."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_every_pair_within_the_radius_shares_a_bucket():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        hidden = (1 << a) | (1 << b)
        assert any(m & hidden == 0 for m in masks)


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(6)]
    rows = []
    for i in range(70):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice("XyZ")
        rows.append((200 - i, "  ".join(words) if i % 9 else None))
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    wanted = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", wanted[i]) for i in prints}


def test_crowded_buckets_lose_no_link(spark):
    """Fingerprints thick around a few centres: buckets of hundreds, chains of links, none beyond the radius."""
    rng = random.Random(1)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(63)
        for _ in range(150):
            value = centre
            for place in rng.sample(range(0, 40, 3), rng.randrange(5)):
                value ^= 1 << place
            prints.add(value)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    labels = {r.node: r.label for r in components(links).collect()}
    wanted = classes(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {p: labels.get(p, p) for p in prints} == wanted


def test_odd_documents(odd, nothing):
    got = simhash.groups(odd).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {"doc_id", "fingerprint", "component_id"}
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[1].fingerprint == of[2].fingerprint == of[3].fingerprint == "0" * 16
    assert of[2].component_id == of[3].component_id == 1 and of[6].component_id == 0
    # rows without id take the component of their fingerprint but name none
    assert sorted(r.component_id for r in got if r.doc_id is None) == [0, 1]
    assert simhash.groups(nothing).count() == 0


def test_one_of_each_group_stays(odd, nothing):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(nothing).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    assert {0, 1, 4, 5, 7} <= set(ids) and not {2, 3, 6} & set(ids)


A, B, C = ("the red fox ran over the long hill", "an entirely other text about rivers", "some third thing said at noon")


def test_rows_not_ids_are_kept(spark):
    """Both texts of an id are judged for themselves: the copy goes, the texts that nothing resembles stay."""
    rows = [(3, A), (5, A), (5, B), (5, C), (5, C), (7, B.upper())]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([(3, A), (5, B), (5, C)])


def test_rows_without_an_id_can_take_part(spark):
    rows = [(None, A), (3, A), (None, B), (None, B), (None, B.upper()), (None, C), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(docs, nameless=True).collect()
    assert [r.doc_id for r in got if r.text == A] == [3]
    assert sorted((r.text or "").lower() for r in got if r.doc_id is None) == sorted(["", B, C])


def test_the_pipeline_removes_copies_without_an_id(spark):
    docs = spark.createDataFrame([(None, A), (None, A), (4, B), (None, B)], "doc_id long, text string")
    got = corpus_pipeline.single_documents(spark, docs, "").collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.where("doc_id = 4 or text like 'the red%'").distinct().collect()))
