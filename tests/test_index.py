"""The index build on a five-record fixture, and feed edge cases."""

import json
import math
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bibspark.catalog import q_analytics
from bibspark.functions.text import STOPWORDS
from bibspark.operators import analytics, clean
from bibspark.plans import explore, index_build
from bibspark.sources import feeds, tables

# Feed records: a repeated word and kept punctuation; a double space and a line break inside an
# abstract; an author of one name; a null abstract in each feed; one word in both feeds, once in capitals.
ARXIV = [
    {"id": "a1", "title": "Winter bees in cold hives", "update_date": "2011-03-02",
     "abstract": "honeybee colonies cluster tightly; honeybee warmth",
     "authors_parsed": [["Okoro", "", ""], ["Lind", "Eva", ""], ["Moreau", "P.", ""]]},
    {"id": "a2", "title": "Salt marsh mapping", "update_date": "2011-07-19", "abstract": "the lidar survey  of\nmarshes",
     "authors_parsed": [["Haddad", "Rim", ""], ["Sato", "Ken", ""]]},
    {"id": "a3", "title": "Draft", "abstract": None, "update_date": "2012-05-05",
     "authors_parsed": [["Lind", "Eva", ""]]},
]
S2 = [
    {"paper_id": "s1", "title": "Honeybee dialects", "year": 2019, "abstract": "HONEYBEE dances differ",
     "authors": [{"first": "Ada", "last": "Vega"}, {"first": "Tom", "last": "Li"}]},
    {"paper_id": "s2", "title": "Poster", "year": 2020, "abstract": None,
     "authors": [{"first": "Ada", "last": "Vega"}]},
]


def write(path, records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("index")
    arxiv, s2 = write(base / "arxiv.json", ARXIV), write(base / "s2.json", S2)
    index_build.build_index(spark, arxiv, s2, str(base / "out"))
    return str(base / "out")


def test_five_records(spark, index, rows):
    t = tables.load_indexes(spark, index)
    assert t["papers"].count() == 3
    assert rows(t["rejected_papers"], "title", "reason") == [
        ("Draft", "failed_validation"), ("Poster", "failed_validation")]
    assert rows(t["author_stats"]) == sorted(
        [(a, 1, 2011) for a in ("Okoro", "Lind Eva", "Moreau P.", "Haddad Rim", "Sato Ken")]
        + [("Ada Vega", 1, 2019), ("Tom Li", 1, 2019)], key=repr)
    # three pairs of the first paper, one of each other
    assert t["collaborations"].count() == 5
    assert t["collaborations"].where("weight <> 1").count() == 0
    topics = {(y, w): n for w, n, y in rows(t["temporal_topics"])}
    assert topics[(2011, "honeybee")] == 2 and topics[(2011, "tightly;")] == 1
    assert topics[(2019, "honeybee")] == 1
    # A newline does not part tokens; words of three letters and stopwords are out.
    assert (2011, "of\nmarshes") in topics and (2011, "of") not in topics and (2011, "the") not in topics


def test_explore(spark, index, rows):
    assert rows(explore.ask(spark, index, "topic", "HONEYBEE")) == [(2011, 2), (2019, 1)]
    assert rows(explore.ask(spark, index, "search", "Honeybee"), "title") == [
        ("Honeybee Dialects",), ("Winter Bees In Cold Hives",)]
    assert rows(explore.ask(spark, index, "network", "Ada Vega")) == [("Ada Vega", "Tom Li", 1)]
    assert rows(explore.ask(spark, index, "author", "Tom Li")) == [(2019, 1)]
    assert rows(explore.ask(spark, index, "sources")) == [("arxiv", 2), ("s2orc", 1)]
    assert rows(explore.ask(spark, index, "rejects"), "total_rejected") == [(2,), (2,)]
    with pytest.raises(ValueError):
        explore.ask(spark, index, "weather")


def test_missing_index_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="papers"):
        tables.load_indexes(spark, str(tmp_path / "none"))


def test_partition_pruning(spark, index):
    papers = tables.load_indexes(spark, index, ["papers"])["papers"]
    plan = papers.where("year = 2023")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2023" in plan.split("PartitionFilters")[1].split("]")[0]


def test_overwrite_scope(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 2000), ("b", 2001)], "x string, year int")
    new = spark.createDataFrame([("c", 2001)], "x string, year int")
    tables.write_partitioned(old, path)
    tables.write_partitioned(new, path, only_present=True)
    assert rows(spark.read.parquet(path)) == [("a", 2000), ("c", 2001)]
    tables.write_partitioned(new, path)
    assert rows(spark.read.parquet(path)) == [("c", 2001)]


def test_validation_edges(spark, rows):
    raw = spark.createDataFrame(
        [("t", "a", ["x"], 2000, "s"), ("t", None, ["x"], 2000, "s"), ("t", None, ["x"], 2000, "s"),
         ("t", "a", [], 2000, "s"), ("t", "a", None, 2000, "s"), ("t", "a", ["x"], None, "s")],
        "title string, abstract string, authors array<string>, year int, source string")
    assert clean.valid_papers(raw).count() == 1
    rejected = clean.rejected_papers(raw)
    assert rejected.count() == 4
    # The same as the set difference.
    other = raw.subtract(clean.valid_papers(raw)).withColumn("reason", F.lit(clean.REASON))
    assert rows(rejected) == rows(other)


def test_dedup_is_by_lowered_title_and_year(spark, rows):
    raw = spark.createDataFrame(
        [("A Title", "z", ["q"], 2000, "s2orc"), ("a title", "y", ["p"], 2000, "arxiv"),
         ("a title", "y", ["p"], 2001, "arxiv")],
        "title string, abstract string, authors array<string>, year int, source string")
    kept = clean.final_layout(clean.dedup_papers(clean.normalise(raw)))
    assert rows(kept, "title", "abstract", "year", "source") == [
        ("a title", "y", 2000, "arxiv"), ("a title", "y", 2001, "arxiv")]


def test_union_of_int_and_long_years(spark):
    a = spark.createDataFrame([("t", 2000)], "title string, year int")
    b = spark.createDataFrame([("u", 2001)], "title string, year bigint")
    assert dict(clean.union_feeds(a, b).dtypes)["year"] == "int"


def test_bad_date_gives_null_year(spark, tmp_path):
    path = write(tmp_path / "feed.json", [{"title": "t", "abstract": "a", "update_date": "abcd-01-01",
                                           "authors_parsed": [["X", "", ""]]}])
    row = feeds.scan_arxiv(spark, path).first()
    assert row.year is None and row.authors == ["X"]


def test_pairs_equal_counted_pairs(spark, rows):
    listed = {"p1": "abcdeab", "p2": "ace", "p3": "z"}
    authors = spark.createDataFrame(
        [(p, a) for p, names in listed.items() for a in names], "paper_id string, author string")
    wanted = Counter((p, x, y) for p, names in listed.items() for x in names for y in names if x < y)
    for block in (1, 2, 3, 200):
        assert rows(analytics.coauthor_pairs(authors, block)) == sorted((*k, n) for k, n in wanted.items())


def test_huge_paper_is_dealt_over_tasks(spark):
    """A paper of 3,000 authors, 100 rows a task: no join task gets the paper's author rows whole."""
    authors = spark.range(3000).select(F.lit("p").alias("paper_id"), F.concat(F.lit("a"), "id").alias("author"))
    keep = {"bibspark.rowsPerTask": "100", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        pairs = analytics.coauthor_pairs(authors, 500)
        parts = pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in parts) == 3000 * 2999 // 2 and len(parts) > 4
    finally:
        for k in keep:
            spark.conf.unset(k)


def test_tfidf_matches_the_hashed_form(spark):
    papers = spark.createDataFrame(
        [("1", "alpha beta beta", 2000), ("2", "alpha gamma", 2000), ("3", "of it", 2001)],
        "paper_id string, abstract string, year int")
    exact = {(r.paper_id, r.token): r.tfidf for r in analytics.tfidf(papers).collect()}
    docs = analytics.hashing_tf(analytics.doc_tokens(papers))
    hashed = {r.paper_id: sorted(r.tfidf_features.values.tolist())
              for r in analytics.tfidf_features(docs).collect()}
    assert set(hashed) == {"1", "2"}
    for p in hashed:
        assert hashed[p] == pytest.approx(sorted(v for (q, _), v in exact.items() if q == p))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_inside_the_row(spark):
    """No exchange and no aggregate of words, so a task's memory does not grow with its papers."""
    papers = spark.createDataFrame(
        [("1", "alpha beta  alpha\nbeta of alpha", 2000), ("2", "", 2000), ("3", None, 2001),
         (None, "of beta beta", None), ("5", "Alpha alpha", 2001)],
        "paper_id string, abstract string, year int")
    counted = analytics.tokenize(papers, counted=True)
    plain = analytics.tokenize(papers).groupBy("paper_id", "year", "token").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert counted.schema["n"].dataType == plain.schema["n"].dataType
    found = q_analytics.filter_tokens(SimpleNamespace(papers=papers))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [("1", "alpha", 2), ("1", "alpha\nbeta", 1), ("1", "beta", 1), (None, "beta", 2), ("5", "alpha", 2)], key=repr)
    assert "Exchange" not in _plan(found) and "Aggregate" not in _plan(found)


def _plain_tfidf(papers):
    """What tfidf gives, in plain Python; rows of one id are one paper."""
    tf, n = Counter(), 0
    for paper, text, _ in papers:
        words = [w for w in (text or "").lower().split(" ") if len(w) > 3 and w not in STOPWORDS]
        tf.update((paper, w) for w in words)
        n += bool(words)
    df = Counter(w for _, w in tf)
    return {k: (c, pytest.approx(c * math.log((n + 1) / (df[k[1]] + 1)))) for k, c in tf.items()}


@pytest.mark.parametrize("common", [0, 3, 200_000])
@pytest.mark.parametrize("rows_per_task", ["4", "1000000"])
def test_tfidf_of_common_and_rare_terms(spark, common, rows_per_task):
    """Terms broadcast, joined, joined in more tasks or hot give the same, also for ids that repeat or are null."""
    papers = [(str(i), f"alpha beta word{i % 7} word{i} word{i} of {'gamma' * (i % 2)}", 2000) for i in range(40)]
    papers += [("1", "beta beta delta", 2000), ("1", "delta", 2001), (None, "alpha", 2000), (None, "alpha word3", 2000),
               ("x", "of it", 2000), ("y", "", 2000), ("z", None, 2000)]
    spark.conf.set("bibspark.rowsPerTask", rows_per_task)
    try:
        found = analytics.tfidf(
            spark.createDataFrame(papers, "paper_id string, abstract string, year int"), common=common).collect()
    finally:
        spark.conf.unset("bibspark.rowsPerTask")
    assert len(found) == len(_plain_tfidf(papers))
    assert {(r.paper_id, r.token): (r.tf, r.tfidf) for r in found} == _plain_tfidf(papers)


def test_tfidf_of_no_words(spark):
    papers = spark.createDataFrame([("1", "of it", 2000), ("2", None, 2000)], "paper_id string, abstract string, year int")
    assert analytics.tfidf(papers).collect() == []


def test_tfidf_shuffles_no_rows_of_common_terms(spark, monkeypatch):
    """Words are counted in the row, and weights of common terms are broadcast."""
    landed, land = {}, analytics.land
    monkeypatch.setattr(analytics, "land", lambda df, name: landed.setdefault(name, _plan(df)) and land(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        papers = spark.createDataFrame([("1", "alpha beta beta", 2000), ("2", "alpha", 2000)],
                                       "paper_id string, abstract string, year int")
        found = analytics.tfidf(papers)
        assert "hashpartitioning" not in _plan(found) and "Exchange" not in landed["term_counts"]
        assert found.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>u1</id><title>Two
lines &amp; more</title><summary>Some
text</summary><published>2020-05-06T00:00:00Z</published>
<author><name>Ann B Cole</name></author></entry>
<entry><id>u2</id><title>Solo</title><published>2021-01-01T00:00:00Z</published>
<author><name>Plato</name></author><author><name>Bo Day</name></author></entry>
<entry><id>u3</id><title>No date</title></entry>
<entry><id>u4</id><published>2021-01-01T00:00:00Z</published></entry>
</feed>"""


def test_atom_entries(spark, tmp_path, rows):
    (tmp_path / "feed.xml").write_text(ATOM)
    got = {r.id: r for r in feeds.atom_entries(spark, str(tmp_path / "feed.xml")).collect()}
    assert set(got) == {"u1", "u2"}
    assert got["u1"].title == "Two lines & more" and got["u1"].abstract == "Some text"
    assert got["u1"].update_date == "2020-05-06" and got["u1"].authors_parsed == [["Cole", "Ann B", ""]]
    assert got["u2"].abstract is None
    assert got["u2"].authors_parsed == [["Plato", "", ""], ["Day", "Bo", ""]]


def test_search_hits(spark):
    payload = json.dumps({"data": [
        {"paperId": "p", "title": "T", "abstract": None, "year": None, "authors": [{"name": "Plato"}, {"name": ""}]},
        {"paperId": "q", "title": "U", "abstract": "x", "year": 2001, "authors": [{"name": "Ann B Cole"}]}]})
    got = {r.paper_id: r for r in
           feeds.search_hits(spark.createDataFrame([(payload,), ('{"total": 0}',)], "payload string")).collect()}
    assert got["p"].year == 2023 and [tuple(a) for a in got["p"].authors] == [("Plato", "")]
    assert got["q"].year == 2001 and [tuple(a) for a in got["q"].authors] == [("Ann B", "Cole")]


def test_ledger_keeps_failed_queries_pending(spark, rows):
    ledger = spark.createDataFrame([("crispr",)], "query string")
    asked = spark.createDataFrame([("CRISPR",), ("Graphs",), ("Genes",)], "query string")
    pending = feeds.pending_queries(asked, ledger)
    assert rows(pending) == [("Genes",), ("Graphs",)]
    added = feeds.ledger_entries(pending.where("query = 'Genes'"), ledger)
    assert rows(added) == [("genes",)]
    assert rows(feeds.pending_queries(asked, ledger.unionByName(added))) == [("Graphs",)]


def test_live_feed_is_preferred(spark, tmp_path):
    sample = write(tmp_path / "sample.json", S2)
    live = str(tmp_path / "live.json")
    assert feeds.first_existing(spark, live, sample) == sample
    write(tmp_path / "live.json", S2)
    assert feeds.first_existing(spark, live, sample) == live
    with pytest.raises(FileNotFoundError):
        feeds.first_existing(spark, str(tmp_path / "no"))
