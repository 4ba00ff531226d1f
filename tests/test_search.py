"""The posting index against scans: every needle, short ones included; lists, skipping."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bibspark.operators import analytics as a
from bibspark.operators import search as s

SCHEMA = "paper_id string, title string, abstract string, authors array<string>, year int, source string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["quantum", "graph", "of", "naïve", "漢字", "🙂", "aaaa", "a", "learning"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(200)]
    texts += [None, "", "a", "ab", "漢", "zebra quagga", "x" * 3000, "aaa", "tail\nline\ttab"]
    papers = spark.createDataFrame([(f"p{i:03}", f"t{i}", t, ["A"], 2000, "s") for i, t in enumerate(texts)], SCHEMA)
    path = str(tmp_path_factory.mktemp("search"))
    s.build(papers, path, block_papers=16)
    return papers.cache(), path


NEEDLES = ["quantum", "Quantum", "tum gra", "zebra", "quagga", "nothing", "a", "ab", "aa", "aaa", "aaaaa", "ï", "漢", "漢字", "🙂", "x" * 50, " ", "\n", "e\tt", ""]


@pytest.mark.parametrize("needle", NEEDLES)
def test_equals_a_scan(spark, index, needle):
    papers, path = index
    want = a.search_abstract(papers, needle)
    got = s.search(spark, path, needle)
    assert sorted(map(tuple, got.select(*SCHEMA_COLUMNS).collect())) == sorted(map(tuple, want.select(*SCHEMA_COLUMNS).collect()))


SCHEMA_COLUMNS = ["paper_id", "abstract", "year"]


def test_lists_hold_every_gram(spark, index):
    papers, path = index
    want = {}
    for r in papers.collect():
        t = r.abstract or ""
        for g in {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t} - {""}:
            want[g] = want.get(g, 0) + 1
    assert {r.gram: r.papers for r in spark.read.parquet(f"{path}/grams").collect()} == want
    assert spark.read.parquet(f"{path}/postings").agg(F.max(F.size("places"))).first()[0] <= 16


def test_places_are_stored_as_differences(index):
    files = glob.glob(f"{index[1]}/postings/*.parquet")
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        column = [group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema.startswith("places")]
        assert "DELTA_BINARY_PACKED" in column[0].encodings
    assert files


def test_a_rare_needle_reads_less(spark, index):
    _, path = index
    counts = [s.candidates(spark, path, n).count() for n in ("quantum", "quagga", "nothing")]
    assert counts[0] > 50 and counts[1:] == [1, 0]
    opened = s.candidates(spark, path, "quagga").select("block").distinct().count()
    assert opened == 1 < s.candidates(spark, path, "quantum").select("block").distinct().count()


def test_many_blocks_are_joined(spark, index, monkeypatch):
    papers, path = index
    monkeypatch.setattr(s, "MOST_NAMED", 2)
    assert s.search(spark, path, "quantum").count() == a.search_abstract(papers, "quantum").count()


def test_lists_are_read_without_joining_every_place(spark, index):
    """Counts, first and last ids against the texts; papers are looked up by gram, not by place."""
    from types import SimpleNamespace

    from bibspark.catalog import q_analytics

    papers, path = index
    held = {}
    for r in papers.where("abstract <> ''").collect():
        for i in range(max(len(r.abstract) - 2, 1)):
            held.setdefault(r.abstract[i : i + 3], set()).add(r.paper_id)
    found = q_analytics.posting_lists(SimpleNamespace(spark=spark, search_index=path))
    want = {(g, len(x), min(x), max(x)) for g, x in held.items()}
    assert {tuple(r) for r in found.select("gram", "papers", "first_id", "last_id").collect()} == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("place#" in x for x in joins)
