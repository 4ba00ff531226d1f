"""Layers, edges, clusters and neighbourhoods of the citation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bibspark.operators import clean
from bibspark.session import land, new_path
from bibspark.skew import find_hot, keep_first, spread_join
from bibspark.sources import tables

# Training code of each intent, anything else is unlabelled; the year and the context
# that stand for missing ones.
INTENT_CODES = {"background": 0, "method": 1, "result": 2}
UNLABELLED = -1
MISSING_YEAR = 2020
NO_CONTEXT = "No context provided"
# Folders of an adjacency, and citing ids of one of its blocks.
BUCKETS, BLOCK = 64, 4096


def unique_papers(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("citing_id", "cited_id")).alias("paper_id"))
    return ends.where("paper_id is not null").distinct()


def dense_index(ids: DataFrame, column: str = "paper_id") -> DataFrame:
    """Each distinct id with its 0-based place in sorted order, without a global window.

    Sorted ids are landed with their partition number and place within it; the
    only thing summed in one task is one row per partition.
    """
    placed = (
        ids.select(column)
        .distinct()
        .orderBy(column)
        .withColumn("_mono", F.monotonically_increasing_id())
        .select(
            column,
            F.shiftright("_mono", 33).alias("_part"),
            F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )
    # Range boundaries are drawn anew on each run of the sort: fix them by landing.
    placed = land(placed, "dense_index")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort is all this window sees.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(
        column, (F.col("_offset") + F.col("_place")).alias("idx")
    )


def map_back_ids(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Dense (citing_idx, cited_idx) edges with the ids of both ends."""
    out, hot = edges, find_hot(edges, "citing_idx", "cited_idx")
    for end in ("citing", "cited"):
        names = index.select(F.col("idx").alias(f"{end}_idx"), F.col("paper_id").alias(f"{end}_id"))
        out = spread_join(out, names, f"{end}_idx", hot=hot)
    return out


def assign_layers(hop0: DataFrame, hop1: DataFrame, hop2: DataFrame, median_year: Column) -> DataFrame:
    """(paper_id, title, abstract, year, layer), one row per paper, the innermost layer wins.

    An id that hop1 cites but the seed table lacks becomes a placeholder seed,
    unless it has metadata of its own as a first-layer paper.
    """
    def rows(df, pid, title, abstract, year, layer, rank, order):
        return df.select(
            F.col(pid).alias("paper_id"),
            title.alias("title"),
            abstract.alias("abstract"),
            year.cast("int").alias("year"),
            F.lit(layer).alias("layer"),
            F.lit(rank).alias("_rank"),
            order.cast("bigint").alias("_order"),
        )

    c = F.col
    known = rows(hop0, "source_paper_id", c("title"), c("abstract"), c("year"), 0, 0, F.lit(0))
    first = rows(hop1, "hop1_id", c("hop1_title"), c("hop1_abstract"), c("hop1_year"), 1, 1, _order_of(hop1))
    ghosts = rows(
        hop1.select("hop0_id").distinct(), "hop0_id", F.lit(clean.NO_TITLE), F.lit(clean.NO_ABSTRACT),
        median_year, 0, 2, F.lit(0),
    )
    second = rows(hop2, "hop2_id", c("hop2_title"), c("hop2_abstract"), c("hop2_year"), 2, 3, _order_of(hop2))
    every = known.unionByName(first).unionByName(ghosts).unionByName(second)
    return keep_first(every, ["paper_id"], ["_rank", "_order"]).drop("_rank", "_order")


def _order_of(layer: DataFrame) -> Column:
    """The order column of a layer, if it has one."""
    return F.col("seq").cast("bigint") if "seq" in layer.columns else F.lit(0).cast("bigint")


def merge_edges(hop1: DataFrame, hop2: DataFrame) -> DataFrame:
    """(src, dst, intent_label, citation_text): both layers, one row per pair, hop1 first.

    A key-citation flag of the first layer is kept as a further column; second-layer
    edges have none.
    """
    flag = "isKeyCitation"
    own = [F.col(flag)] if flag in hop1.columns else []
    none = [F.lit(None).cast("boolean").alias(flag)] if own else []
    first = hop1.select(
        F.col("hop1_id").alias("src"), F.col("hop0_id").alias("dst"), "intent_label", "citation_text", *own,
        F.lit(0).alias("_rank"), _order_of(hop1).alias("_order"),
    )
    second = hop2.select(
        F.col("hop2_id").alias("src"), F.col("hop1_id").alias("dst"),
        F.lit(str(UNLABELLED)).alias("intent_label"), "citation_text", *none,
        F.lit(1).alias("_rank"), _order_of(hop2).alias("_order"),
    )
    edges = keep_first(first.unionByName(second), ["src", "dst"], ["_rank", "_order"])
    return clean.fill_context(edges.drop("_rank", "_order"))


def export_contexts(hop1: DataFrame, hop2: DataFrame) -> DataFrame:
    """(citing_id, cited_id, citation_text) of both layers, rows without text left out."""
    first = hop1.select(
        F.col("hop1_id").alias("citing_id"), F.col("hop0_id").alias("cited_id"), "citation_text",
        F.lit(0).alias("_rank"), _order_of(hop1).alias("_order"),
    )
    second = hop2.select(
        F.col("hop2_id").alias("citing_id"), F.col("hop1_id").alias("cited_id"), "citation_text",
        F.lit(1).alias("_rank"), _order_of(hop2).alias("_order"),
    )
    rows = first.unionByName(second).na.drop(subset=["citation_text"])
    return keep_first(rows, ["citing_id", "cited_id"], ["_rank", "_order"]).drop("_rank", "_order")


def valid_edges(edges: DataFrame, papers: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose two ends are known papers (one row per paper)."""
    out, hot = edges, find_hot(edges, src, dst)
    for end in (src, dst):
        known = papers.select(F.col("paper_id").alias(end))
        out = spread_join(out, known, end, "left_semi", hot=hot)
    return out


def encode_intent(edges: DataFrame, label: str = "intent_label") -> DataFrame:
    code = F.lit(UNLABELLED)
    for name, value in INTENT_CODES.items():
        code = F.when(F.lower(label) == name, value).otherwise(code)
    return edges.withColumn("intent_code", code).withColumn("train_mask", F.col("intent_code") >= 0)


def delta_t_scaled(citing_year: Column, cited_year: Column) -> Column:
    """Years apart, at least 1; 1 where a year is missing."""
    return F.greatest(F.lit(1), F.coalesce(citing_year - cited_year, F.lit(1)))


def delta_t_clamp0(citing_year: Column, cited_year: Column) -> Column:
    """Years apart, at least 0; 0 where a year is missing."""
    return F.greatest(F.lit(0), F.coalesce(citing_year - cited_year, F.lit(0)))


def delta_t_default(citing_year: Column, cited_year: Column, default: int = MISSING_YEAR) -> Column:
    """Years apart, at least 0, a missing year being `default`."""
    d = F.lit(default)
    return F.greatest(F.lit(0), F.coalesce(citing_year, d) - F.coalesce(cited_year, d))


def with_years(
    edges: DataFrame, papers: DataFrame, src: str = "src", dst: str = "dst", how: str = "left",
    hot: dict[str, DataFrame | None] | None = None,
) -> DataFrame:
    """Edges with the year of both ends; ``how="inner"`` also drops edges of unknown papers.

    `hot` is what `find_hot` found for both ends, if it is known already.
    """
    out, hot = edges, hot or find_hot(edges, src, dst)
    for end, name in ((src, "citing_year"), (dst, "cited_year")):
        years = papers.select(F.col("paper_id").alias(end), F.col("year").alias(name))
        out = spread_join(out, years, end, how, hot=hot)
    return out


def author_dim(hop2_edges: DataFrame) -> DataFrame:
    """Distinct author ids of the JSON lists; a list that does not parse has none."""
    return _listed_authors(hop2_edges).select("author_id").distinct()


def _listed_authors(hop2_edges: DataFrame) -> DataFrame:
    ids = F.from_json("hop2_author_ids", "array<string>")
    return hop2_edges.select(
        F.col("hop2_paper_id").alias("paper_id"), F.explode(ids).alias("author_id")
    ).where("author_id is not null")


def writes_edges(hop2_edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(author_id, paper_id) rows for known papers, repeated lists kept."""
    known = papers.select("paper_id")
    return spread_join(_listed_authors(hop2_edges), known, "paper_id", "left_semi").select(
        "author_id", "paper_id"
    )


def active_cluster(citations: DataFrame, hop2_edges: DataFrame) -> DataFrame:
    """Labelled citation rows whose citing paper is itself cited by the second layer."""
    active = hop2_edges.select(F.col("hop1_paper_id").alias("citingPaperId")).na.drop().distinct()
    return spread_join(citations, active, "citingPaperId", "left_semi")


# The wording of the texts below is fixed: titles, years, sections, sentences and abstracts in this frame.
def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def seed_text(title: Column, year: Column, abstract: Column) -> Column:
    text = F.concat(
        F.lit("Title: "), _said(title), F.lit(". Year: "), _said(year), F.lit(". Abstract: "), _said(abstract)
    )
    return F.when((_said(title) != "") | (_said(abstract) != ""), text).otherwise("Empty Seed Node")


def hop1_text(title, year, section, sentence, abstract) -> Column:
    return F.concat(
        F.lit("Title: "), _said(title), F.lit(". Year: "), _said(year),
        F.lit(". Citation to Target ["), _said(section), F.lit("]: '"), _said(sentence),
        F.lit("'. Abstract: "), _said(abstract),
    )


def hop2_text(title, year, context, abstract) -> Column:
    return F.concat(
        F.lit("Title: "), _said(title), F.lit(". Year: "), _said(year),
        F.lit(". Citation Context: '"), _said(context), F.lit("'. Abstract: "), _said(abstract),
    )


def joined_text(title: Column, abstract: Column) -> Column:
    """Title and abstract with the separator of the scaled run."""
    return F.concat(title, F.lit(" [SEP] "), abstract)


def plain_text(abstract: Column) -> Column:
    return F.coalesce(abstract, F.lit("Scientific research paper."))


def node_texts(citations: DataFrame, hop2_edges: DataFrame, meta: DataFrame) -> DataFrame:
    """(paper_id, node_text), one per node of the active cluster.

    A first-layer paper takes the text of its last citation row, and wins over a
    seed of the same id; a second-layer paper takes its first row and only counts
    if it is in no inner layer. `meta` is (paper_id, title, year, abstract), the
    row order of both edge tables is their `seq`.
    """
    info = meta.select("paper_id", "title", "year", "abstract")
    rows = active_cluster(citations, hop2_edges)
    c = F.col
    seeds = rows.select(c("citedPaperId").alias("paper_id")).na.drop().distinct()
    seeds = seeds.join(info, "paper_id", "left").select(
        "paper_id", seed_text(c("title"), c("year"), c("abstract")).alias("node_text"), F.lit(1).alias("_rank")
    )
    last = keep_first(
        rows.select(c("citingPaperId").alias("paper_id"), (-c("seq")).alias("_o"), "sectionName", "string"),
        ["paper_id"],
        ["_o"],
    )
    first_layer = last.join(info, "paper_id", "left").select(
        "paper_id",
        hop1_text(c("title"), c("year"), c("sectionName"), c("string"), c("abstract")).alias("node_text"),
        F.lit(0).alias("_rank"),
    )
    second = keep_first(
        hop2_edges.select(
            c("hop2_paper_id").alias("paper_id"), "seq", "hop2_title", "hop2_year", "hop2_abstract",
            "citation_context",
        ),
        ["paper_id"],
        ["seq"],
    ).select(
        "paper_id",
        hop2_text(c("hop2_title"), c("hop2_year"), c("citation_context"), c("hop2_abstract")).alias("node_text"),
        F.lit(2).alias("_rank"),
    )
    every = seeds.unionByName(first_layer).unionByName(second)
    return keep_first(every, ["paper_id"], ["_rank"]).drop("_rank")


def layer_counts(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, count): papers, edges, labelled edges, and papers per layer."""
    n = F.count(F.lit(1)).alias("count")
    by_layer = papers.groupBy("layer").agg(n).select(
        F.concat(F.lit("layer_"), F.col("layer").cast("string")).alias("item"), "count"
    )
    labelled = F.count_if("train_mask").alias("count")
    return (
        papers.agg(n).select(F.lit("papers").alias("item"), "count")
        .unionByName(edges.agg(n).select(F.lit("edges").alias("item"), "count"))
        .unionByName(edges.agg(labelled).select(F.lit("labelled_edges").alias("item"), "count"))
        .unionByName(by_layer)
    )


def citation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cited_id").agg(F.count(F.lit(1)).alias("n"))


def dense_seeds(edges: DataFrame, k: int = 5) -> DataFrame:
    """Distinct papers citing one of the k most cited ids."""
    top = citation_counts(edges).orderBy(F.desc("n"), "cited_id").limit(k)
    # k rows.
    return (
        edges.join(F.broadcast(top), "cited_id", "left_semi")
        .select("citing_id").na.drop().distinct()
    )


def seed_candidates(edges: DataFrame, low: int = 10, high: int = 30, k: int = 100) -> DataFrame:
    """The k most cited ids among those with low..high citation rows."""
    return (
        citation_counts(edges)
        .where(F.col("n").between(low, high))
        .orderBy(F.desc("n"), "cited_id")
        .limit(k)
    )


def cluster_members(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct (cited_id, citing_id) of the given seeds."""
    return (
        spread_join(edges.select("cited_id", "citing_id"), seeds.select("cited_id"), "cited_id", "left_semi")
        .na.drop()
        .distinct()
    )


def completeness(papers: DataFrame) -> DataFrame:
    """(paper_id, complete): a title, and an abstract of more than 20 characters."""
    ok = (F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("abstract"), F.lit(0)) > 20)
    return papers.select("paper_id", ok.alias("complete"))


def rank_clusters(members: DataFrame, papers: DataFrame, k: int | None = 5) -> DataFrame:
    """Clusters of complete seeds by share of complete members, then size."""
    known = completeness(papers)
    full = F.coalesce("complete", F.lit(False))
    rated = spread_join(
        members, known.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left"
    ).groupBy("cited_id").agg(
        F.count(F.lit(1)).alias("hop1_count"), F.count_if(full).alias("perfect_hop1_count")
    )
    seeds = known.where("complete").select(F.col("paper_id").alias("cited_id"))
    ranked = (
        rated.join(seeds, "cited_id", "left_semi")
        .withColumn("ratio", F.col("perfect_hop1_count") / F.col("hop1_count"))
        .orderBy(F.desc("ratio"), F.desc("hop1_count"), "cited_id")
        .withColumnRenamed("cited_id", "seed")
    )
    return ranked if k is None else ranked.limit(k)


def cluster_roots(edges: DataFrame) -> DataFrame:
    """Cited papers that cite nothing."""
    citing = edges.select(F.col("citing_id").alias("root")).distinct()
    return edges.select(F.col("cited_id").alias("root")).distinct().join(citing, "root", "left_anti")


def root_members(edges: DataFrame) -> DataFrame:
    """Distinct (root, member)."""
    pairs = edges.select(F.col("cited_id").alias("root"), F.col("citing_id").alias("member"))
    return spread_join(pairs, cluster_roots(edges), "root", "left_semi").distinct()


def bridge_papers(members: DataFrame) -> DataFrame:
    """Members of more than one root, with their number of roots."""
    return (
        members.distinct()
        .groupBy("member")
        .agg(F.count(F.lit(1)).alias("roots"))
        .where("roots > 1")
    )


def isolation_report(edges: DataFrame) -> DataFrame:
    """One row: roots, members, and violations (roots beyond a member's first)."""
    members = root_members(edges)
    per_member = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return per_member.agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"),
        F.count_if(F.col("n") > 1).alias("bridges"),
    ).withColumn("roots", cluster_roots(edges).agg(F.count(F.lit(1))).scalar())


def _bucket(paper: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(paper), F.lit(buckets)).cast("int")


def adjacency(edges: DataFrame, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(bucket, cited_id, citing_ids): who cites a paper, as sorted blocks of about `block` ids at most.

    The ids of a paper with more citing papers are dealt over as many blocks as it needs by
    their hash, so that no task gathers them.
    """
    pairs = edges.select("cited_id", "citing_id").na.drop()
    counts = citation_counts(pairs)
    large = counts.where(F.col("n") > block // 2).select("cited_id", "n", F.ceil(F.col("n") * 2 / block).alias("_parts"))
    part = F.pmod(F.xxhash64("citing_id"), F.coalesce("_parts", F.lit(1)))
    dealt = spread_join(pairs, large, "cited_id", "left", rows="n").select("cited_id", "citing_id", part.alias("_part"))
    blocks = dealt.groupBy("cited_id", "_part").agg(F.sort_array(F.collect_set("citing_id")).alias("citing_ids"))
    return blocks.select(_bucket("cited_id", buckets).alias("bucket"), "cited_id", "citing_ids")


def touched_blocks(blocks: DataFrame, frontier: DataFrame, opened: list[int]) -> DataFrame:
    """The blocks of the frontier's papers, from the folders `opened` alone, those of the papers' buckets."""
    some = blocks.where(F.col("bucket").isin(opened))
    return some.join(frontier.select(F.col("paper_id").alias("cited_id")), "cited_id", "left_semi")


def land_level(papers: DataFrame, base: str, level: int, buckets: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Writes a level below `base`; returns it, all levels so far (paper_id, level), and the buckets of
    its papers, at most `buckets` numbers: none for an empty level."""
    only = papers.select("paper_id")
    only.write.parquet(f"{base}/level={level}")
    read = papers.sparkSession.read
    schema = StructType([only.schema["paper_id"], StructField("level", IntegerType())])
    landed = read.schema(only.schema).parquet(f"{base}/level={level}")
    opened = landed.select(_bucket("paper_id", buckets).alias("b")).distinct().collect()
    return landed, read.schema(schema).parquet(base), [r.b for r in opened]


def snowball(
    edges: DataFrame,
    seed: DataFrame,
    max_papers: int | None = None,
    blocks: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first over incoming citations from a one-row (paper_id) seed.

    Returns (paper_id, level) and (cited_id, citing_id, context) of the reached
    papers. `blocks` is the `adjacency` of the edges as read from folders by bucket; without
    it, it is written first. A level reads the folders that its frontier's papers fall in and
    no other edge, so a walk costs what it reaches, not levels times the graph. Levels are
    landed in the shared folder: lineage stays one level deep, a lost executor costs no more
    than the level at hand, and only bucket numbers reach the
    driver. With `max_papers` the reached papers are the first by (level, id).
    """
    if blocks is None:
        path = new_path(edges.sparkSession, "adjacency")
        tables.write_partitioned(adjacency(edges, buckets), path, "bucket", ["cited_id"])
        blocks = edges.sparkSession.read.parquet(path)
    level = 0
    base = new_path(edges.sparkSession, "snowball")
    frontier, reached, opened = land_level(seed, base, level, buckets)
    total = 1
    while opened and (max_papers is None or total < max_papers):
        level += 1
        found = (
            touched_blocks(blocks, frontier, opened)
            .select(F.explode("citing_ids").alias("paper_id"))
            .distinct()
            .join(reached, "paper_id", "left_anti")
        )
        frontier, reached, opened = land_level(found, base, level, buckets)
        if max_papers is not None:
            total = reached.count()
    if max_papers is not None:
        reached = reached.orderBy("level", "paper_id").limit(max_papers)
    ids = reached.select("paper_id")
    kept = valid_edges(edges, ids, "cited_id", "citing_id").select(
        "cited_id", "citing_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")
    )
    return reached, kept


def in_degree(papers: DataFrame, edges: DataFrame) -> DataFrame:
    counts = citation_counts(edges).withColumnRenamed("cited_id", "paper_id")
    return papers.select("paper_id").join(counts, "paper_id", "left").select(
        "paper_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("in_degree")
    )


def graph_tables(citations: DataFrame, hop2_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (id, group, title) and typed distinct edges (source, target, kind)."""
    rows = active_cluster(citations, hop2_edges)
    c = F.col

    def nodes(df, pid, group, title, rank):
        return df.select(
            pid.alias("id"), F.lit(group).cast("string").alias("group"), title.alias("title"), F.lit(rank).alias("_rank"),
            (c("seq") if "seq" in df.columns else F.lit(0)).cast("bigint").alias("_order"),
        )

    no_title = F.lit(None).cast("string")
    authors = _listed_authors(hop2_edges).select(
        F.concat(F.lit("author_"), "author_id").alias("author_node"), "paper_id"
    )
    # Drawn seed first, then redrawn as first layer: the later drawing of an id stays.
    every = (
        nodes(rows.select("citingPaperId", "citingPaperTitle", (-c("seq")).alias("seq")),
              c("citingPaperId"), "hop1", c("citingPaperTitle"), 0)
        .unionByName(nodes(rows.select("citedPaperId").distinct(), c("citedPaperId"), "seed", no_title, 1))
        .unionByName(nodes(hop2_edges, c("hop2_paper_id"), "hop2", c("hop2_title"), 2))
        .unionByName(nodes(authors, c("author_node"), "author", no_title, 3))
        .unionByName(nodes(hop2_edges.select("hop1_paper_id").distinct(), c("hop1_paper_id"), None, no_title, 4))
    )
    node_table = keep_first(every.na.drop(subset=["id"]), ["id"], ["_rank", "_order"]).drop("_rank", "_order")

    def edge(df, s, t, kind):
        return df.select(c(s).alias("source"), c(t).alias("target"), F.lit(kind).alias("kind"))

    edge_table = (
        edge(rows, "citingPaperId", "citedPaperId", "cites")
        .unionByName(edge(hop2_edges, "hop2_paper_id", "hop1_paper_id", "cites"))
        .unionByName(edge(authors, "author_node", "paper_id", "writes"))
        .distinct()
    )
    return node_table, edge_table


# Which groups a click on a node of a group opens.
OPENS = {"seed": ["hop1"], "hop1": ["hop2", "author"], "hop2": ["author"]}


def _touching(edges: DataFrame, node: str | Column) -> DataFrame:
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    return (
        edges.where((F.col("source") == node) | (F.col("target") == node))
        .select(other.alias("id"))
        .distinct()
    )


def drill_down(nodes: DataFrame, edges: DataFrame, node: str | Column) -> DataFrame:
    """Neighbours of a node in the groups its own group opens."""
    group = nodes.where(F.col("id") == node).agg(F.max("group")).scalar()
    opened = F.lit(False)
    for own, others in OPENS.items():
        opened = opened | ((group == own) & F.col("group").isin(others))
    return nodes.join(_touching(edges, node), "id", "left_semi").where(opened)


def two_hop_neighbourhood(edges: DataFrame, node: str | Column) -> DataFrame:
    """(id, degree): the node (0), its neighbours (1) and theirs (2), least degree each."""
    near = _touching(edges, node)
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(
        edges.select(F.col("target").alias("id"), F.col("source").alias("other"))
    )
    far = spread_join(ends, near, "id", "left_semi").select(F.col("other").alias("id"))
    start = edges.sparkSession.range(1).select(F.lit(node).alias("id"))
    return (
        start.withColumn("degree", F.lit(0))
        .unionByName(near.withColumn("degree", F.lit(1)))
        .unionByName(far.withColumn("degree", F.lit(2)))
        .groupBy("id")
        .agg(F.min("degree").alias("degree"))
    )


def property_filter(
    nodes: DataFrame, edges: DataFrame, item: str, prop: str, values: list[str]
) -> DataFrame:
    """Ids of nodes with the property in `values`, or of both ends of such edges."""
    if item == "node":
        return nodes.where(F.col(prop).cast("string").isin(values)).select("id").distinct()
    if item == "edge":
        hit = edges.where(F.col(prop).cast("string").isin(values))
        return hit.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    raise ValueError(f"item is 'node' or 'edge', not {item!r}")


def edge_profile(hop2_edges: DataFrame) -> DataFrame:
    """One row: edge rows, distinct second-layer papers, distinct first-layer papers."""
    return hop2_edges.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("hop2_paper_id").alias("hop2_papers"),
        F.countDistinct("hop1_paper_id").alias("hop1_papers"),
    )
