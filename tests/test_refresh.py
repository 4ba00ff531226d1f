"""Indexes refreshed batch by batch: any split, with a restart and repeats, gives the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from bibspark.operators import analytics as a
from bibspark.plans import index_refresh
from bibspark.streaming import refresh as r


def made_up(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"p{i}", f"t{i}", " ".join(rng.choices(["quantum", "graphs", "the", "learning", "x"], k=6)),
         rng.choices(["Ann", "Bo", "Cy", "Di"], k=rng.randrange(1, 4)), 2000 + rng.randrange(3), "s")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, r.PAPERS)


def same(got, want):
    cols = sorted(want.columns)
    return sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def all_equal(spark, out, papers):
    return all(same(r.read_index(spark, out, name), adds(papers)) for name, (adds, _) in r.INDEXES.items())


@pytest.mark.parametrize("arrivals,files_per_batch,compact_every", [(1, 100, 20), (3, 1, 2)])
def test_any_split_gives_the_batch_result(spark, tmp_path, arrivals, files_per_batch, compact_every):
    papers = made_up(spark)
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    number = F.pmod(F.crc32("paper_id"), F.lit(arrivals))
    for k in range(arrivals):
        # earlier papers arrive once more with every arrival
        papers.where(number <= k).coalesce(1).write.mode("append").json(landing)
        r.refresh(spark, landing, out, state, files_per_batch=files_per_batch, compact_every=compact_every)
        assert all_equal(spark, out, papers.where(number <= k))
    # nothing new: nothing changes
    r.refresh(spark, landing, out, state, files_per_batch=files_per_batch)
    assert all_equal(spark, out, papers) and same(r.read_papers(spark, out), papers)


def test_a_batch_that_failed_half_way_is_written_anew(spark, tmp_path, monkeypatch):
    papers = made_up(spark)
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    papers.repartition(2).write.json(landing)
    whole, calls = r.add_batch, []

    def broken(batch, number, *rest):
        calls.append(number)
        if len(calls) == 2:
            batch.write.mode("overwrite").parquet(f"{out}/papers/batch={number}")
            a.author_stats(batch).write.mode("overwrite").parquet(f"{out}/author_stats/additions/batch={number}")
            raise RuntimeError("lost")
        whole(batch, number, *rest)

    monkeypatch.setattr(r, "add_batch", broken)
    with pytest.raises(Exception, match="lost"):
        r.refresh(spark, landing, out, state, files_per_batch=1, compact_every=1)
    r.refresh(spark, landing, out, state, files_per_batch=1, compact_every=1)
    assert calls[1] == calls[2]
    assert all_equal(spark, out, papers)


def test_an_unfinished_total_is_not_read(spark, tmp_path):
    papers = made_up(spark)
    out = str(tmp_path / "out")
    r.add_batch(papers, 0, out)
    r.read_index(spark, out, "author_stats").write.parquet(f"{out}/author_stats/totals/batch=0")
    assert all_equal(spark, out, papers)


def test_feed_rows(spark, tmp_path):
    rows = [("T", "An Abstract", ["A", "B"], 2001, "arxiv"), ("T", "An Abstract", ["A", "B"], 2001, "arxiv"),
            ("U", None, ["A"], 2001, "arxiv"), ("V", "text", [], 2001, "s2"), (None, "text", ["A"], 2001, "s2")]
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    spark.createDataFrame(rows, index_refresh.FEED).write.json(landing)
    r.refresh(spark, landing, out, state, index_refresh.feed_papers, index_refresh.FEED)
    assert [tuple(x) for x in r.read_index(spark, out, "collaborations").collect()] == [("A", "B", 1)]
