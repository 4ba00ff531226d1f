"""The whole pipeline, and each of its stages, on odd rows, clashing columns and empty tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from bibspark.llm.queries import tokenizer_file
from bibspark.llm.tokens import PartEncoder
from bibspark.session import land
from tests.llm.test_simhash import classes, fingerprint

LABELS = "doc_id long, quality int, toxic int, score double, row long"
BENCHMARK = "item_id long, text string, doc_id long, size long, tile long"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Odd rows, repeated once more, a passage of the benchmark in one; labels and items with gaps and repeats."""
    path = str(tmp_path_factory.mktemp("odd"))
    taken = spark.createDataFrame([(20, f"before {PASSAGE} after", "en", "s")], "doc_id long, text string, lang string, source string")
    odd.unionByName(odd.where("doc_id in (0, 9)")).unionByName(taken, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    labels = [(i, None if i == 3 else 1, 0, 0.1, 1) for i in range(13)] + [(None, 0, 1, None, None), (0, 1, 0, 0.2, 2), (99, 0, 0, 0.0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    items = [(1, PASSAGE, 5, 6, 7), (1, PASSAGE, 5, 6, 7), (2, None, 0, 0, 0), (3, "", 0, 0, 0), (None, " \n", 0, 0, 0)]
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = land(stage(spark, before, folder), f"odd-{name}")
        assert docs.columns == before.columns
        assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mixing"
        kept[name] = docs
    # one text of each group of linked fingerprints, whether its rows have an id or not
    given = [r.text for r in kept["quality"].select("text").collect()]
    single = [fingerprint(r.text) for r in kept["near_duplicates"].select("text").collect()]
    prints = {i: fingerprint(t) for i, t in enumerate(given)}
    groups = set(classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2).values())
    assert len(single) == len(groups)
    # the passage of the benchmark goes, nothing else does
    gone = kept["near_duplicates"].select("text").exceptAll(kept["decontamination"].select("text")).collect()
    had = [t for t in (r.text for r in kept["near_duplicates"].select("text").collect()) if t and PASSAGE in t]
    assert [r.text for r in gone] == had


def test_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    coder = PartEncoder(tokenizer_file())
    texts = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = np.frombuffer(coder.whole(r.text), "<u2").astype("<u4") if r.text else np.zeros(0, "<u4")
        texts.setdefault(r.doc_id, set()).add((len(ids) + 1, zlib.crc32(np.append(ids, 0).astype("<u4").tobytes())))
    assert got and all((r.n_tokens, r.ids_crc32) in texts[r.doc_id] for r in got)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]]).tolist()[:-1]
    assert not any(r.doc_id == 20 for r in got)


@pytest.mark.parametrize("empty", [["documents"], ["labels"], ["benchmark"], ["documents", "labels", "benchmark"]])
def test_empty_tables(spark, folder, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name in empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert (got.count() == 0) == ("documents" in empty)
