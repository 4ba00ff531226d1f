"""The ranking kept up to date against the full run, after every batch, with restarts and repeated batches."""

import json
import random

import pytest

from bibspark.operators import metrics
from bibspark.streaming import ranking as rk

COLUMNS = ["author_id", "normal_hp_frac", "semantic_hp_frac", "total_papers", "impact_shift"]


def made_up(rng, papers=40, n=420):
    edges = []
    for _ in range(n):
        a, b = rng.randrange(papers), min(rng.randrange(papers), rng.randrange(papers))
        edges.append((f"p{a}", f"p{b}", rng.choice([0.5, 1.2, 1.5, 0.3333333])))
    edges += [("hub", f"p{i}", 1.0) for i in range(30)] + [(f"p{i}", "hub", 1.5) for i in range(25)]
    rng.shuffle(edges)
    writes = [(f"a{rng.randrange(12)}", f"p{rng.randrange(papers)}") for _ in range(90)]
    return edges, writes + writes[:4] + [("a0", "never cited"), ("idle", "unknown"), ("hubbist", "hub")]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, rk.EDGES)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("limit", [None, "10"])
def test_equals_the_full_run(spark, tmp_path, limit):
    rng = random.Random(4)
    edges, writes = made_up(rng)
    writes_df = spark.createDataFrame(writes, "author_id string, paper_id string")
    out = f"{tmp_path}/state"
    if limit:
        spark.conf.set("bibspark.rowsPerTask", limit)
    try:
        rk.start(writes_df, out, buckets=4)
        assert result(rk.ranking(spark, out)) == []
        seen, cuts = [], [0, 230, 231, len(edges)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            seen += edges[a:b]
            rk.add_citations(edges_of(spark, edges[a:b]), out, number, buckets=4)
            if number == 2:  # run again, as after a failure
                rk.add_citations(edges_of(spark, edges[a:b]), out, number, buckets=4)
            want = result(metrics.hp_frac(edges_of(spark, seen), writes_df))
            assert len(want) > 3 and result(rk.ranking(spark, out)) == want
    finally:
        spark.conf.unset("bibspark.rowsPerTask")


def test_compacted_state_goes_on(spark, tmp_path):
    edges, writes = made_up(random.Random(5), n=150)
    writes_df = spark.createDataFrame(writes, "author_id string, paper_id string")
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    rk.start(writes_df, old, buckets=4)
    rk.add_citations(edges_of(spark, edges[:120]), old, 1, buckets=4)
    rk.compact(spark, old, new, buckets=4)
    assert result(rk.ranking(spark, new)) == result(rk.ranking(spark, old))
    # no id, no weight, and a batch of nothing
    rk.add_citations(edges_of(spark, edges[120:] + [(None, "p1", 1.0), ("p1", None, 1.0), ("p2", "p3", None)]), new, 2, buckets=4)
    rk.add_citations(edges_of(spark, []), new, 3, buckets=4)
    assert result(rk.ranking(spark, new)) == result(metrics.hp_frac(edges_of(spark, edges + [("p2", "p3", None)]), writes_df))


def test_untouched_buckets_stay_closed(spark, tmp_path):
    """A batch about one pair of papers still works when all folders of other buckets hold rubbish."""
    writes = [(f"a{i}", f"p{i}") for i in range(200)]
    ring = [(f"p{i}", f"p{(i + 1) % 200}", 1.5) for i in range(200)]
    writes_df = spark.createDataFrame(writes, "author_id string, paper_id string")
    out = f"{tmp_path}/state"
    rk.start(writes_df, out)
    rk.add_citations(edges_of(spark, ring), out, 1)
    more = [("p7", "p8", 1.5)] * 3
    touched = {}
    for table, ids in {
        "citations": ["p8"], "scores": ["p7", "p8"], "paper_counts": ["p8", "p9"], "indexes": ["p8", "p9"],
        "author_rows": ["p8", "p9"], "author_counts": ["a8", "a9"],
    }.items():
        keys = spark.createDataFrame([(i,) for i in ids], "k string").select(rk._bucket("k", rk.BUCKETS).alias("b"))
        touched[table] = {r.b for r in keys.collect()}
        spoiled = 0
        for file in (tmp_path / "state" / table).glob("batch=*/bucket=*/*.parquet"):
            if int(file.parent.name.split("=")[1]) not in touched[table]:
                file.write_bytes(b"no parquet file")
                spoiled += 1
        assert spoiled
    rk.add_citations(edges_of(spark, more), out, 2)
    assert result(rk.ranking(spark, out)) == result(metrics.hp_frac(edges_of(spark, ring + more), writes_df))


def test_stream_with_restart(spark, tmp_path):
    edges, writes = made_up(random.Random(6), n=90)
    writes_df = spark.createDataFrame(writes, "author_id string, paper_id string")
    landing, out = tmp_path / "landing", f"{tmp_path}/state"
    landing.mkdir()
    rk.start(writes_df, out)
    names = ["citing_id", "cited_id", "semantic_weight"]
    for k, part in enumerate([edges[:70], edges[70:]]):
        (landing / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, e))) for e in part))
        rk.follow(spark, str(landing), out, f"{tmp_path}/checkpoint")
    assert result(rk.ranking(spark, out)) == result(metrics.hp_frac(edges_of(spark, edges), writes_df))
    with pytest.raises(ValueError):
        rk.add_citations(edges_of(spark, edges), out, 0)


def test_values_that_stay_make_no_rows_and_counts_move_once(spark, tmp_path):
    schema = "paper_id string, old_raw bigint, raw bigint, old_s double, s_c double"
    rows = spark.createDataFrame([("p", 1, 2, 1.2, 1.9), ("p", 2, 2, 0.5, 2.0), ("q", None, 0, 0.0, 0.4)], schema)
    both = {"h": ("old_raw", "raw"), "s": ("old_s", "s_c")}
    got = rk._changes(rows, "paper_id", {m: (rows[a], rows[b]) for m, (a, b) in both.items()})
    want = [("p", "h", 1, -1), ("p", "h", 2, 1), ("p", "s", 0, -1), ("p", "s", 2, 1)]
    assert sorted(tuple(r) for r in got.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = f"{tmp_path}/state"
        rk.start(spark.createDataFrame([("a", "p")], "author_id string, paper_id string"), out, buckets=2)
        counts = rk._Step(spark, out, 1, 2).add_counts("paper_counts", got)
        assert sorted(tuple(r) for r in counts.collect()) == [("p", "h", 2, 1), ("p", "s", 2, 1)]
        index = metrics.hirsch_of_counts(counts, "paper_id", ["h", "s"], placed=True)
        assert [tuple(r) for r in index.collect()] == [("p", 1.0, 1.0)]
        plan = index._jdf.queryExecution().executedPlan().toString().split("Union")[0]
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
