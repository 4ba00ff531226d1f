"""Layers, edges, clusters, neighbourhoods, features and ingest."""

import json
import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.operators import features as f
from bibspark.operators import graph as g
from bibspark.sources import feeds, payloads, tables
from bibspark.streaming import ingest
from tests_data import H0, H1, H2, citing_pairs


def edges_of(spark, pairs):
    return spark.createDataFrame([(*p, None) for p in pairs], "citing_id string, cited_id string, context string")


def test_layers(spark, rows):
    h0 = spark.createDataFrame([("s", "Seed", None, 1990)], H0)
    h1 = spark.createDataFrame([("a", "s", "A", None, 2000, None, None, 1), ("s", "a", "S again", None, 2001, None, None, 2),
                                ("a", "ghost", "A", None, 2000, None, None, 3)], H1)
    h2 = spark.createDataFrame([("b", "a", "B", None, 2010, None, 1), ("a", "b", "A2", None, 2010, None, 2),
                                ("ghost", "b", "G", None, 2011, None, 3)], H2)
    got = rows(g.assign_layers(h0, h1, h2, F.lit(2005)), "paper_id", "title", "year", "layer")
    # Cited-only ids are placeholder seeds; an id with first-layer metadata keeps it.
    assert got == [("a", "A", 2000, 1), ("b", "B", 2010, 2), ("ghost", "Unknown Title", 2005, 0), ("s", "Seed", 1990, 0)]


def test_merge_prefers_the_first_layer(spark, rows):
    h1 = spark.createDataFrame([("a", "s", "A", None, 1, "method", None, 1)], H1)
    h2 = spark.createDataFrame([("a", "s", "A", None, 1, "text", 1), ("b", "a", "B", None, 1, "ctx", 2)], H2)
    merged = g.merge_edges(h1, h2)
    assert rows(merged) == [("a", "s", "method", "Citation context missing."), ("b", "a", "-1", "ctx")]
    assert rows(g.encode_intent(merged), "src", "intent_code", "train_mask") == [("a", 1, True), ("b", -1, False)]


def test_years_apart(spark):
    df = spark.createDataFrame([(2010, 2000), (2000, 2010), (2000, 2000), (None, 2000), (2000, None)], "s int, d int")
    s, d = F.col("s"), F.col("d")
    got = [tuple(r) for r in df.select(g.delta_t_scaled(s, d), g.delta_t_clamp0(s, d), g.delta_t_default(s, d)).collect()]
    assert got == [(10, 10, 10), (1, 0, 0), (1, 0, 0), (1, 0, 20), (1, 0, 0)]


def test_dense_index_is_the_sorted_place(spark):
    ids = [f"p{i * 7919 % 5000:05d}" for i in range(5000)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:100]], "paper_id string").repartition(13)
    got = {r.paper_id: r.idx for r in g.dense_index(df).collect()}
    assert got == {p: i for i, p in enumerate(sorted(set(ids)))}


def test_snowball_against_a_queue(spark, rows):
    pairs = citing_pairs(60)
    level, queue = {"n0": 0}, ["n0"]
    while queue:
        here = queue.pop(0)
        for a, b in pairs:
            if b == here and a not in level:
                level[a] = level[here] + 1
                queue.append(a)
    seed = spark.createDataFrame([("n0",)], "paper_id string")
    reached, kept = g.snowball(edges_of(spark, pairs), seed)
    assert {r.paper_id: r.level for r in reached.collect()} == level
    assert rows(kept, "citing_id", "cited_id") == sorted(
        {p for p in pairs if p[0] in level and p[1] in level}, key=repr)
    assert kept.first().context == "No context provided"
    capped, _ = g.snowball(edges_of(spark, pairs), seed, max_papers=7)
    assert [r.paper_id for r in capped.orderBy("level", "paper_id").collect()] == [
        p for _, p in sorted((v, k) for k, v in level.items())][:7]


def test_adjacency_blocks(spark, tmp_path):
    """Lists of every paper come back whole from blocks, one paper with many citing ones from several."""
    pairs = citing_pairs(60) + [(f"m{i:04}", "hot") for i in range(900)] + [("m0001", "hot"), (None, "hot"), ("m0001", None)]
    blocks = g.adjacency(edges_of(spark, pairs), buckets=8, block=100)
    tables.write_partitioned(blocks, str(tmp_path / "a"), "bucket")
    blocks = spark.read.parquet(str(tmp_path / "a"))
    lists = {}
    for r in blocks.collect():
        assert r.citing_ids == sorted(r.citing_ids) and len(r.citing_ids) <= 100
        lists[r.cited_id] = lists.get(r.cited_id, []) + r.citing_ids
    assert len([1 for r in blocks.collect() if r.cited_id == "hot"]) > 9
    want = {}
    for a, b in pairs:
        if a is not None and b is not None:
            want.setdefault(b, set()).add(a)
    assert {k: sorted(v) for k, v in lists.items()} == {k: sorted(v) for k, v in want.items()}
    # a level opens the folders of its frontier only
    walk, two = str(tmp_path / "walk"), spark.createDataFrame([("hot",), ("n1",)], "paper_id string")
    frontier, reached, opened = g.land_level(two, walk, 3, 8)
    assert sorted(map(tuple, reached.collect())) == [("hot", 3), ("n1", 3)]
    assert 0 < len(opened) <= 2
    assert {r.cited_id for r in g.touched_blocks(blocks, frontier, opened).collect()} == {"hot", "n1"}
    read = blocks.where(F.col("bucket").isin(opened)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in read} == set(opened)
    assert g.land_level(frontier.limit(0), walk, 4, 8)[2] == []


def test_roots_and_bridges(spark, rows):
    edges = edges_of(spark, [("a", "r1"), ("a", "r2"), ("b", "r1"), ("c", "a"), ("a", "r1")])
    assert rows(g.cluster_roots(edges)) == [("r1",), ("r2",)]
    assert rows(g.bridge_papers(g.root_members(edges))) == [("a", 2)]
    assert g.isolation_report(edges).first().asDict() == {"members": 2, "violations": 1, "bridges": 1, "roots": 2}


def test_cluster_ranking(spark):
    edges = edges_of(spark, [("a", "s"), ("b", "s"), ("a", "t"), ("x", "u")])
    long = "an abstract of more than twenty letters"
    papers = spark.createDataFrame([("s", "S", long), ("t", "T", long), ("u", "U", "short"), ("a", "A", long), ("b", "", long)],
                                   "paper_id string, title string, abstract string")
    got = [tuple(r) for r in g.rank_clusters(edges.select("cited_id", "citing_id"), papers)
           .select("seed", "hop1_count", "perfect_hop1_count", "ratio").collect()]
    assert got == [("t", 1, 1, 1.0), ("s", 2, 1, 0.5)]


def test_drill_down_and_two_hops(spark, rows):
    nodes = spark.createDataFrame([("s", "seed"), ("h", "hop1"), ("k", "hop2"), ("w", "author")], "id string, group string")
    edges = spark.createDataFrame([("h", "s", "cites"), ("k", "h", "cites"), ("w", "k", "writes")],
                                  "source string, target string, kind string")
    assert rows(g.drill_down(nodes, edges, "s"), "id") == [("h",)]
    assert rows(g.drill_down(nodes, edges, "h"), "id") == [("k",)]
    assert rows(g.drill_down(nodes, edges, "k"), "id") == [("w",)]
    assert rows(g.drill_down(nodes, edges, "w"), "id") == []
    assert rows(g.two_hop_neighbourhood(edges, "s")) == [("h", 1), ("k", 2), ("s", 0)]
    assert rows(g.property_filter(nodes, edges, "edge", "kind", ["writes"])) == [("k",), ("w",)]
    with pytest.raises(ValueError):
        g.property_filter(nodes, edges, "label", "kind", [])


def test_attention_sums_to_one(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(f"n{i}", rng.normal(size=8).tolist()) for i in range(60)],
                                    "paper_id string, vector array<double>")
    edges = edges_of(spark, citing_pairs(60)).distinct().withColumn("delta_t", F.lit(2))
    spark.conf.set("bibspark.rowsPerTask", "4")
    try:
        att = f.temporal_attention(edges, vectors, 0.1)
        sums = [r.s for r in att.groupBy("cited_id").agg(F.sum("alpha").alias("s")).collect()]
        assert sums and all(abs(s - 1) < 1e-9 for s in sums) and att.count() == edges.count()
        vec = {r.paper_id: np.array(r.vector) for r in vectors.collect()}
        out = {r.paper_id: np.array(r.vector) for r in f.attention_sum(att, vectors).collect()}
        for p in out:
            wanted = sum(r.alpha * vec[r.citing_id] for r in att.where(F.col("cited_id") == p).collect())
            assert np.allclose(out[p], wanted)
    finally:
        spark.conf.unset("bibspark.rowsPerTask")


def test_embeddings(spark):
    def make_length_encoder():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(i, "a" * i + "b") for i in range(40)] + [(99, None)], "id int, text string")
    got = {r.id: list(r.embedding) for r in f.embed(df, "text", make_length_encoder).collect()}
    assert got[7] == [8.0, 7.0] and got[99] == [0.0, 0.0]
    hashed = f.embed(df, "text", dim=32).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in hashed)


def test_models_beat_the_majority(spark):
    rng = np.random.default_rng(7)
    data = []
    for i in range(600):
        c = int(rng.choice(3, p=[0.6, 0.2, 0.2]))
        x = rng.normal(size=4) + 2.5 * np.eye(4)[c]
        data.append((f"a{i}", f"b{i}", c, bool(x[3] > 0), x.tolist()))
    edges = f.edge_split(spark.createDataFrame(
        data, "citing_id string, cited_id string, intent_code int, is_key boolean, features array<double>"))
    train = edges.where("split = 'train'")
    pred = f.predict_edges(edges, f.fit_intent(train), f.fit_importance(train))
    report = {r.split: r for r in f.accuracy_mae(pred, "predicted_code", "intent_code", "raw_importance", "is_key").collect()}
    assert set(report) == {"train", "val", "test"}
    assert report["train"].accuracy > 0.8 and report["test"].accuracy > 0.7 and report["test"].mae < 0.3
    weights = {r.intent_code: r.weight for r in f.class_weights(train, "intent_code").collect()}
    assert abs(sum(weights.values()) - 3) < 1e-9 and weights[0] < weights[1]


def test_projection_is_the_leading_components(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(50, 6)) * np.array([5, 3, 1, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "paper_id int, vector array<double>")
    got = np.array([[r.x, r.y] for r in f.project_2d(df).orderBy("paper_id").collect()])
    axes = np.linalg.svd(data - data.mean(axis=0))[2][:2]
    for i in range(2):
        wanted = data @ axes[i]
        assert np.allclose(got[:, i], wanted) or np.allclose(got[:, i], -wanted)


def reply(hop1, *ids):
    data = [{"contexts": [f"ctx {i}", "more"] if i != "noctx" else [], "citingPaper": {
        "paperId": i, "title": f"T{i}", "year": 2000, "abstract": "A",
        "authors": [{"authorId": "1"}, {"authorId": None}]}} for i in ids]
    data += [{"contexts": None, "citingPaper": None}, {"contexts": None, "citingPaper": {"paperId": None}}]
    return {"hop1_id": hop1, "payload": json.dumps({"data": data})}


def test_ingest_resumes_without_repeats(spark, tmp_path, rows):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    schema = "hop1_id string, payload string"
    feeds.landing_append(spark.createDataFrame([reply("h1", "a", "noctx")], schema), landing)
    ingest.ingest_citations(spark, landing, out, state)
    feeds.landing_append(spark.createDataFrame([reply("h2", "b"), {"hop1_id": "h3", "payload": "{}"}], schema), landing)
    for _ in range(2):
        ingest.ingest_citations(spark, landing, out, state)
    got = ingest.read_edges(spark, out)
    assert rows(got, "hop1_paper_id", "hop2_paper_id", "citation_context", "hop2_author_ids") == [
        ("h1", "a", "ctx a", '["1"]'), ("h1", "noctx", None, '["1"]'), ("h2", "b", "ctx b", '["1"]')]
    assert payloads.consolidate_chunks(got.unionByName(got)).count() == 3
    ids = spark.createDataFrame([("h1",), ("h9",)], "hop1_paper_id string")
    assert rows(ingest.remaining(ids, got, "hop1_paper_id")) == [("h9",)]


def test_author_replies_are_positional(spark, rows):
    payload = json.dumps([{"authors": [{"authorId": "1", "name": "A"}, {"authorId": None, "name": None}]}, None, {"authors": []}])
    df = spark.createDataFrame([(["p", "q", "r"], payload)], "ids array<string>, payload string")
    got = payloads.flatten_authors(df)
    assert rows(got) == [("p", 0, "1", "A"), ("p", 1, None, "Unknown")]


def test_whole_chain(spark, tmp_path):
    from bibspark.plans import citation_chain, impact_report

    base = str(tmp_path / "hops")
    pairs = citing_pairs(40)
    labels = ["background", "method", "result"]
    year = {f"n{i}": 1980 + i for i in range(40)}
    first = [(a, b, f"title {a}", None, year[a], labels[i % 3], f"as in {labels[i % 3]} of, \"{b}\"\nmore",
              i % 3 == 1) for i, (a, b) in enumerate(pairs) if b in ("n0", "n1", "n2")]
    second = [(a, b, f"title {a}", "text", year[a], None) for a, b in pairs if b not in ("n0", "n1", "n2")]
    tables.export_csv(spark.createDataFrame([("n0", "Zero", "abc", 1980, "Ann, Bo")], H0 + ", authors string"),
                      f"{base}/hop0_metadata_final.csv")
    tables.export_csv(spark.createDataFrame(first, H1.replace(", seq int", "") + ", isKeyCitation boolean"),
                      f"{base}/hop1_final_dataset_rescued.csv")
    tables.export_csv(spark.createDataFrame([(1, 9.0, 0.4, 0.1), (2, 3.0, 0.6, 0.3)], schemas.TRAINING_LOG).coalesce(1),
                      f"{base}/log.csv")
    tables.export_csv(spark.createDataFrame(second, H2.replace(", seq int", "")), f"{base}/hop2_final_dataset.csv")
    tables.export_csv(spark.createDataFrame([(f"n{i}", f"w{i % 5}", f"W{i % 5}", "S2") for i in range(40)],
                      "paper_id string, author_id string, author_name string, source string"), f"{base}/authors.csv")
    out = str(tmp_path / "out")
    ranking = citation_chain.run(spark, base, f"{base}/authors.csv", out, log=f"{base}/log.csv")
    # the last λ of the log weighs the edges, and importance is that of the flag
    weighted = spark.read.parquet(f"{out}/weighted_edges")
    assert weighted.where(F.abs(F.col("decay_factor") - F.exp(F.col("delta_t") * -0.3)) > 1e-9).count() == 0
    assert weighted.where("raw_importance between 0 and 1").count() == weighted.count()
    assert 0 < ranking.count() <= 5 and ranking.where("normal_hp_frac <= 0").count() == 0
    papers = spark.read.parquet(f"{out}/papers")
    assert papers.where("layer = 0").count() == 1 and papers.count() == len({x for p in pairs for x in p})
    assert spark.read.parquet(f"{out}/edges").count() == len(set(pairs))
    contexts = spark.read.parquet(f"{out}/citation_contexts")
    assert contexts.count() == len({(a, b) for a, b, *_ in first}) and "\n" in contexts.first().citation_text

    impact = spark.createDataFrame([("n0", 2.5, 4)], impact_report.IMPACT)
    meta = spark.createDataFrame([("n0", "Zero", 1980, "Ann, Bo")], "source_paper_id string, title string, year int, authors string")
    board = impact_report.report(impact, meta, str(tmp_path / "report")).collect()
    assert [(r.author, r.total_semantic_impact) for r in board] == [("Ann", 2.5), ("Bo", 2.5)]


def test_layers_are_read_in_file_order(spark, tmp_path):
    """The first of two rows of one pair is kept, though the second sorts before it; no flag, no column."""
    from bibspark.operators import clean

    base = tmp_path / "hops"
    base.mkdir()
    (base / "hop0_metadata_final.csv").write_text("source_paper_id,title,abstract,year,authors\nr,Z,,1990,A\nr,A,,1991,B\n")
    (base / "hop1_final_dataset_rescued.csv").write_text(
        "hop1_id,hop0_id,hop1_title,hop1_abstract,hop1_year,intent_label,citation_text\n"
        "a,r,Zed,,2000,method,z\na,r,Abc,,2000,method,a\n")
    (base / "hop2_final_dataset.csv").write_text(
        "hop2_id,hop1_id,hop2_title,hop2_abstract,hop2_year,citation_text\nb,a,Zwei,,2001,z\nb,a,Acht,,2001,a\n")
    for multi_line in (True, False):
        layers = clean.clean_layers(*tables.scan_hops(spark, str(base), multi_line), ["seq"])
        assert [h.first()[c] for h, c in zip(layers, ("title", "hop1_title", "hop2_title"))] == ["Z", "Zed", "Zwei"]
        assert "isKeyCitation" not in layers[1].columns


def test_attention_with_a_vector_of_the_edge(spark):
    from bibspark.operators import features

    v = {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": [3.0, 1.0]}
    edges = [("a", "c", 1.0, [2.0, 1.0]), ("b", "c", 4.0, [-1.0, 3.0]), ("b", "a", 0.0, [1.0, 1.0]), ("x", "a", 0.0, [1.0, 1.0])]
    vectors = spark.createDataFrame(list(v.items()), "paper_id string, vector array<float>")
    df = spark.createDataFrame(edges, "citing_id string, cited_id string, delta_t double, context array<float>")
    got = {(r.citing_id, r.cited_id): (r.score, r.alpha)
           for r in features.temporal_attention(df, vectors, 0.1, "context").collect()}
    score = {(a, b): sum(x * y * z for x, y, z in zip(v[b], v[a], e)) / 2**0.5 * math.exp(-0.1 * t)
             for a, b, t, e in edges if a in v}
    assert set(got) == set(score)
    for (a, b), (s, alpha) in got.items():
        total = sum(math.exp(x) for (_, to), x in score.items() if to == b)
        assert s == pytest.approx(score[a, b]) and alpha == pytest.approx(math.exp(score[a, b]) / total)
