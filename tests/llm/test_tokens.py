"""Token files and flat files against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bibspark.llm import token_counts, token_files
from bibspark.llm.queries import tokenizer_file
from bibspark.llm.tokens import PartEncoder
from bibspark.session import new_path


@pytest.fixture(scope="module")
def coder():
    return PartEncoder(tokenizer_file())


def test_parts_give_the_ids_of_whole_texts(coder):
    rng = random.Random(0)
    bits = [*"ab'sZ 1.,\n\t  é漢\x1c\x85!🙂<|>", " ", "\n", "'s", "the", "<|endoftext|>", "don't", " A%%%", "é...", "b…",
            "漢!!", "9,", " ", "᠎", " x's.", " y", " z\n"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(3000)]
    for some in (texts, texts[:50], ["one\ntwo, three"], [], [""], [None, "a"]):
        ids, bounds = coder.encode(pa.array(some, pa.string()))
        got = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        assert got == [coder.whole(t) if t else b"" for t in some]


def test_round_trip_and_places(spark, odd, coder):
    path = new_path(spark, "tokens")
    token_files.write(odd.repartition(3), path, tokenizer_file())
    rows = odd.select("doc_id", "text").collect()
    ids = [(r.doc_id, [*np.frombuffer(coder.whole(r.text or "") if r.text else b"", "<u2").tolist(), 0]) for r in rows]
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]]).tolist()[:-1]
    assert [r.doc_id for r in got] == sorted([i for i, _ in ids], key=lambda i: (i is not None, i or 0))
    assert sorted([(str(r.doc_id), list(r.ids)) for r in got]) == sorted((str(i), t) for i, t in ids)
    for r in token_files.digest(token_files.read(spark, path)).collect():
        assert r.ids_crc32 in {zlib.crc32(np.array(t, "<u4").tobytes()) for i, t in ids if i == r.doc_id}


def test_counts_are_read_without_ids(spark, odd):
    path = new_path(spark, "tokens")
    token_files.write(odd, path, tokenizer_file())
    plan = token_files.read(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    one = token_files.read(spark, path).where("doc_id = 4")
    assert "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


def test_empty_tables(spark, nothing):
    path = new_path(spark, "tokens")
    token_files.write(nothing, path, tokenizer_file())
    assert token_files.digest(token_files.read(spark, path)).count() == 0
    flat = new_path(spark, "flat")
    token_counts.write(nothing, flat, tokenizer_file())
    assert token_counts.count(token_counts.read_blocks(spark, flat)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_documents_across_blocks(spark, odd, coder, block):
    small = odd.where("doc_id is null or doc_id not in (7, 8)").repartition(2)
    path = new_path(spark, "flat")
    token_counts.write(small, path, tokenizer_file())
    got = token_counts.count(token_counts.read_blocks(spark, path, block)).collect()
    texts = [r.text for r in small.select("text").collect()]
    wanted = sorted(len(coder.whole(t)) // 2 if t else 0 for t in texts)
    assert sorted(r.n_tokens for r in got) == wanted
    for file in {r.file for r in got}:
        own = sorted([r for r in got if r.file == file], key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *[r.n_tokens + 1 for r in own]]).tolist()[:-1]


def test_a_cut_off_tail_is_no_document(spark):
    blocks = spark.createDataFrame([("f", 0, 4, [1]), ("f", 1, 4, []), ("f", 2, 4, [2]), ("f", 3, 2, []), ("g", 0, 3, [])],
                                   "file string, block long, size long, ends array<long>")
    got = sorted(map(tuple, token_counts.count(blocks).collect()))
    assert got == [("f", 0, 0, 1), ("f", 1, 2, 8)]
    assert blocks.where(F.col("file") == "none").count() == 0
