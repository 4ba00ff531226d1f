"""The pipeline stage by stage on the smallest tables, and the queries with SQL against it."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from bibspark.llm import mixing, quality
from bibspark.llm.queries import ORACLES, QUERIES, tokenizer_file
from bibspark.llm.tokens import PartEncoder
from bibspark.session import land
from tests.llm.test_simhash import classes, fingerprint
from tools.check_sql import rows as comparable

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    stages = dict(corpus_pipeline.STAGES)

    kept = land(stages["quality"](spark, docs, DATA), "t")
    trees = quality.fit(docs, labels)
    good = {r.doc_id for r in quality.score(docs, trees).collect() if r.predicted == 1}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == columns

    single = land(stages["near_duplicates"](spark, kept, DATA), "t")
    prints = {r.doc_id: fingerprint(r.text) for r in kept.collect()}
    of = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(of.values())) and single.columns == columns

    clean = land(stages["decontamination"](spark, single, DATA), "t")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in single.collect()}
    gone = set(texts) - {r.doc_id for r in clean.collect()}
    assert gone == {i for i, t in texts.items() if any(x in t for x in items)} and clean.columns == columns

    mixed = land(stages["mixing"](spark, clean, DATA), "t")
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(clean), [3.0, 1.0, 2.0], 1.5).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert mixed.columns == columns and max(copies.values()) == 2

    tokens = stages["token_files"](spark, mixed, DATA).collect()
    coder = PartEncoder(tokenizer_file())
    wanted = sorted((r.doc_id, len(coder.whole(r.text)) // 2 + 1) for r in mixed.collect())
    got = sorted((r.doc_id, r.n_tokens, r.start) for r in tokens)
    assert [g[:2] for g in got] == wanted
    assert [g[2] for g in sorted(got, key=lambda g: g[2])] == np.cumsum([0, *[n for _, n in wanted]]).tolist()[:-1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, cur.fetchall())


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
