"""Periodic runs: the grid against the definition, the index against plain comparison, defined results."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from bibspark.llm import queries
from bibspark.llm import runs as r


def brute_runs(words, least=12):
    """All maximal stretches of every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def made_up(rng):
    n, kinds = rng.choice([0, 1, 11, 12, 13, 30, 100, 300]), rng.choice([1, 2, 2, 3, 30])
    words = [rng.randrange(1, kinds + 1) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("modulus", sorted(r.COVERS))
def test_runs_by_definition(modulus):
    rng = random.Random(modulus)
    for _ in range(120):
        texts = [made_up(rng) for _ in range(rng.randrange(1, 8))]
        least = rng.choice([2, 4, 12])
        got = r.find([np.array(t, np.int32) for t in texts], least, modulus)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(t, least) for t in texts]


@pytest.mark.parametrize("modulus", sorted(r.COVERS))
def test_covers_hold_every_difference_once(modulus):
    cover = r.COVERS[modulus]
    assert sorted((a - b) % modulus for a in cover for b in cover if a != b) == list(range(1, modulus))


@pytest.mark.parametrize("modulus", sorted(r.COVERS))
def test_common_extensions(modulus):
    rng = random.Random(5)
    texts = [np.array(made_up(rng), np.int32) for _ in range(20)]
    words, doc, ends = r._layout(texts)
    extend = r.CommonExtensions(words, doc, modulus)
    for k, t in enumerate(texts):
        if len(t) < 2:
            continue
        opens = ends[k] - len(t)
        pairs = [rng.sample(range(len(t)), 2) for _ in range(60)]
        got = extend(*(np.array([p[s] for p in pairs]) + opens for s in (0, 1)))
        for (i, j), length in zip(pairs, got.tolist()):
            plain = 0
            while max(i, j) + plain < len(t) and t[i + plain] == t[j + plain]:
                plain += 1
            assert length == plain


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(8)
    texts = [np.array(made_up(rng), np.int32) for _ in range(30)]
    whole = r.find(texts)
    monkeypatch.setattr(r, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, r.find(texts)))


def test_query_by_definition(spark, odd, tmp_path):
    """The registered query against the contract's words, over odd rows and planted stretches."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "b", "cé", "d"], k=rng.randrange(0, 90)))) for i in range(100, 300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in queries.op13(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text in docs.collect():
        words = (text or "").encode().split()
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words) if n < 5000 else []
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want.append((
            doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        ))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in got) > 10


def test_odd_tables(spark, odd, nothing):
    got = r.periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert got.count() == odd.count() and r.periodic_runs(nothing).count() == 0
    blank = [x for x in got.collect() if x.doc_id in (1, 2, 3)]
    assert [(x.n_words, x.runs, bytes(x.collapsed)) for x in blank] == [(0, [], b"")] * 3


def test_a_long_text_of_one_word_and_one_of_a_long_period(spark):
    period = [f"w{i}" for i in range(15_000)]
    docs = spark.createDataFrame([(1, "ha " * 60_000), (2, " ".join(period * 3))], "doc_id long, text string")
    got = {x.doc_id: x for x in r.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 60_000, 1)] and bytes(got[1].collapsed) == b"ha"
    assert [tuple(x) for x in got[2].runs] == [(0, 45_000, 15_000)]
    assert bytes(got[2].collapsed).decode().split() == period
