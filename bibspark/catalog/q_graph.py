"""Citation graph queries."""

from pyspark.sql import functions as F

from bibspark.catalog.registry import query
from bibspark.operators import graph as g

# The seed with most citation rows.
NODE = "(SELECT cited_paper FROM active GROUP BY cited_paper ORDER BY count(*) DESC, cited_paper LIMIT 1)"
PAPERS = "(SELECT citing_id AS paper_id FROM cites UNION SELECT cited_id FROM cites)"


@query("unique_papers", "cites", f"SELECT paper_id FROM {PAPERS}")
def unique_papers(t):
    return g.unique_papers(t.cites)


@query(
    "dense_index",
    "cites",
    f"SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS idx FROM {PAPERS}",
)
def dense_index(t):
    return g.dense_index(g.unique_papers(t.cites))


@query("map_back_ids", "cites", "SELECT citing_id, cited_id FROM cites")
def map_back_ids(t):
    index = g.dense_index(g.unique_papers(t.cites))
    dense = t.cites.select("citing_id", "cited_id")
    for end in ("citing", "cited"):
        dense = dense.join(
            index.select(F.col("paper_id").alias(f"{end}_id"), F.col("idx").alias(f"{end}_idx")),
            f"{end}_id",
        )
    return g.map_back_ids(dense.select("citing_idx", "cited_idx"), index).select("citing_id", "cited_id")


@query("assign_layers", "layers", "SELECT * FROM layers")
def assign_layers(t):
    return g.assign_layers(*t._imputed())


@query("merge_edges", "merged", "SELECT * FROM merged")
def merge_edges(t):
    return g.merge_edges(t.cleaned[1], t.cleaned[2])


@query(
    "valid_edges",
    "cites clean0",
    """
SELECT citing_id, cited_id FROM cites
WHERE citing_id IN (SELECT paper_id FROM nodes WHERE abstract IS NOT NULL)
  AND cited_id IN (SELECT paper_id FROM nodes WHERE abstract IS NOT NULL)""",
)
def valid_edges(t):
    known = t.nodes.where("abstract is not null").select("paper_id")
    return g.valid_edges(t.cites.select("citing_id", "cited_id"), known, "citing_id", "cited_id")


@query(
    "encode_intent",
    "merged",
    """
SELECT src, dst, code AS intent_code, code >= 0 AS train_mask
FROM (SELECT src, dst, CASE lower(intent_label) WHEN 'background' THEN 0 WHEN 'method' THEN 1
             WHEN 'result' THEN 2 ELSE -1 END AS code FROM merged)""",
)
def encode_intent(t):
    coded = g.encode_intent(t.merged)
    return coded.select("src", "dst", "intent_code", "train_mask")


@query(
    "delta_t_scaled",
    "merged layers",
    """
SELECT src, dst, greatest(1, s.year - d.year) AS delta_t
FROM merged JOIN layers s ON s.paper_id = src JOIN layers d ON d.paper_id = dst""",
)
def delta_t_scaled(t):
    edges = g.with_years(t.merged.select("src", "dst"), t.layers, how="inner")
    return edges.select(
        "src", "dst", g.delta_t_scaled(F.col("citing_year"), F.col("cited_year")).alias("delta_t")
    )


@query(
    "delta_t_clamp0",
    "cites",
    "SELECT citing_id, cited_id, greatest(0, coalesce(citing_year - cited_year, 0)) AS delta_t FROM cites",
)
def delta_t_clamp0(t):
    edges = g.with_years(t.cites.select("citing_id", "cited_id"), t.nodes, "citing_id", "cited_id")
    return edges.select(
        "citing_id",
        "cited_id",
        g.delta_t_clamp0(F.col("citing_year"), F.col("cited_year")).alias("delta_t"),
    )


@query(
    "delta_t_default",
    "cites",
    """
SELECT citing_id, cited_id,
       greatest(0, coalesce(citing_year, 2020) - coalesce(cited_year, 2020)) AS delta_t
FROM cites""",
)
def delta_t_default(t):
    edges = g.with_years(t.cites.select("citing_id", "cited_id"), t.nodes, "citing_id", "cited_id")
    return edges.select(
        "citing_id",
        "cited_id",
        g.delta_t_default(F.col("citing_year"), F.col("cited_year")).alias("delta_t"),
    )


@query(
    "author_dim",
    "hop2_edges",
    "SELECT DISTINCT author_id FROM (SELECT unnest(author_ids) AS author_id FROM hop2_edges)",
)
def author_dim(t):
    return g.author_dim(t.hop2_edges)


@query(
    "writes_edges",
    "hop2_edges nodes",
    """
SELECT author_id, paper_id, count(*) AS n
FROM (SELECT unnest(author_ids) AS author_id, hop2_paper_id AS paper_id FROM hop2_edges)
WHERE paper_id IN (SELECT paper_id FROM nodes WHERE abstract IS NOT NULL) GROUP BY ALL""",
)
def writes_edges(t):
    rows = g.writes_edges(t.hop2_edges, t.nodes.where("abstract is not null"))
    return rows.groupBy("author_id", "paper_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "active_cluster", "active", "SELECT citing_paper, cited_paper, label, seq FROM active"
)
def active_cluster(t):
    return g.active_cluster(t.citations, t.hop2_edges).select(
        F.col("citingPaperId").alias("citing_paper"), F.col("citedPaperId").alias("cited_paper"), "label", "seq"
    )


@query(
    "node_texts",
    "active nodes",
    """
, n AS (SELECT paper_id, coalesce(title, '') AS t, coalesce(CAST(year AS VARCHAR), '') AS y,
               coalesce(abstract, '') AS a FROM nodes),
x AS (
  SELECT DISTINCT cited_paper AS id, CASE WHEN t <> '' OR a <> ''
         THEN 'Title: ' || t || '. Year: ' || y || '. Abstract: ' || a ELSE 'Empty Seed Node' END AS txt,
         1 AS rank, 0 AS rn
  FROM active JOIN n ON paper_id = cited_paper
  UNION ALL
  SELECT citing_paper, 'Title: ' || t || '. Year: ' || y || '. Citation to Target [' || section || ']: '''
         || coalesce(string, '') || '''. Abstract: ' || a, 0,
         row_number() OVER (PARTITION BY citing_paper ORDER BY seq DESC, section, string NULLS FIRST) - 1
  FROM active JOIN n ON paper_id = citing_paper
  UNION ALL
  SELECT hop2_paper_id, 'Title: ' || t || '. Year: ' || y || '. Citation Context: '''
         || coalesce(citation_context, '') || '''. Abstract: ' || a, 2,
         row_number() OVER (PARTITION BY hop2_paper_id ORDER BY seq, citation_context NULLS FIRST) - 1
  FROM hop2_edges JOIN n ON paper_id = hop2_paper_id)
SELECT id AS paper_id, arg_min(txt, rank) AS node_text FROM x WHERE rn = 0 GROUP BY id""",
)
def node_texts(t):
    return g.node_texts(t.citations, t.hop2_edges, t.nodes)


@query(
    "scaled_texts", "layers", "SELECT paper_id, title || ' [SEP] ' || abstract AS node_text FROM layers"
)
def scaled_texts(t):
    return t.layers.select("paper_id", g.joined_text(F.col("title"), F.col("abstract")).alias("node_text"))


@query(
    "abstract_texts",
    "nodes",
    "SELECT paper_id, coalesce(abstract, 'Scientific research paper.') AS node_text FROM nodes",
)
def abstract_texts(t):
    return t.nodes.select("paper_id", g.plain_text(F.col("abstract")).alias("node_text"))


@query(
    "layer_counts",
    "layers merged",
    """
SELECT 'papers' AS item, count(*) AS count FROM layers
UNION ALL SELECT 'edges', count(*) FROM merged
UNION ALL SELECT 'labelled_edges', count(*) FROM merged
          WHERE lower(intent_label) IN ('background', 'method', 'result')
UNION ALL SELECT 'layer_' || CAST(layer AS VARCHAR), count(*) FROM layers GROUP BY layer""",
)
def layer_counts(t):
    return g.layer_counts(t.layers, g.encode_intent(t.merged))


COUNTS = "(SELECT cited_id, count(*) AS n FROM cites GROUP BY cited_id)"


@query(
    "dense_seeds",
    "cites",
    f"""
SELECT DISTINCT citing_id FROM cites
WHERE cited_id IN (SELECT cited_id FROM {COUNTS} ORDER BY n DESC, cited_id LIMIT 5)""",
)
def dense_seeds(t):
    return g.dense_seeds(t.cites)


CANDIDATES = f"(SELECT * FROM {COUNTS} WHERE n BETWEEN 10 AND 30 ORDER BY n DESC, cited_id LIMIT 100)"


@query("seed_candidates", "cites", f"SELECT * FROM {CANDIDATES}")
def seed_candidates(t):
    return g.seed_candidates(t.cites)


@query(
    "cluster_members",
    "cites",
    f"""
SELECT DISTINCT cited_id, citing_id FROM cites WHERE cited_id IN (SELECT cited_id FROM {CANDIDATES})""",
)
def cluster_members(t):
    return g.cluster_members(t.cites, g.seed_candidates(t.cites))


COMPLETE = """(SELECT paper_id, coalesce(length(title), 0) > 0 AND coalesce(length(abstract), 0) > 20
  AS complete FROM nodes)"""


@query("completeness", "nodes", f"SELECT paper_id, complete FROM {COMPLETE}")
def completeness(t):
    return g.completeness(t.nodes)


RANKED = f"""
  SELECT cited_id AS seed, count(*) AS hop1_count, count(*) FILTER (WHERE c.complete) AS perfect_hop1_count,
         count(*) FILTER (WHERE c.complete) / count(*) AS ratio
  FROM cites JOIN {COMPLETE} c ON c.paper_id = citing_id JOIN {COMPLETE} s ON s.paper_id = cited_id
  WHERE s.complete"""


@query(
    "rank_clusters",
    "cites nodes",
    f"""
{RANKED} AND cited_id IN (SELECT cited_id FROM {CANDIDATES}) GROUP BY cited_id
ORDER BY ratio DESC, hop1_count DESC, seed LIMIT 5""",
)
def rank_clusters(t):
    members = g.cluster_members(t.cites, g.seed_candidates(t.cites))
    return g.rank_clusters(members, t.nodes)


@query("rank_all_clusters", "cites nodes", f"{RANKED} GROUP BY cited_id")
def rank_all_clusters(t):
    return g.rank_clusters(t.cites.select("cited_id", "citing_id"), t.nodes, k=None)


ROOTS = "(SELECT cited_id AS root FROM cites EXCEPT SELECT citing_id FROM cites)"
MEMBERS = f"(SELECT DISTINCT cited_id AS root, citing_id AS member FROM cites WHERE cited_id IN (SELECT root FROM {ROOTS}))"


@query("cluster_roots", "cites", f"SELECT root FROM {ROOTS}")
def cluster_roots(t):
    return g.cluster_roots(t.cites)


@query("root_members", "cites", f"SELECT * FROM {MEMBERS}")
def root_members(t):
    return g.root_members(t.cites)


@query(
    "bridge_papers",
    "cites",
    f"SELECT member, count(*) AS roots FROM {MEMBERS} GROUP BY member HAVING count(*) > 1",
)
def bridge_papers(t):
    return g.bridge_papers(g.root_members(t.cites))


@query(
    "isolation_report",
    "cites",
    f"""
SELECT count(*) AS members, CAST(sum(n - 1) AS BIGINT) AS violations,
       count(*) FILTER (WHERE n > 1) AS bridges, (SELECT count(*) FROM {ROOTS}) AS roots
FROM (SELECT member, count(*) AS n FROM {MEMBERS} GROUP BY member)""",
)
def isolation_report(t):
    return g.isolation_report(t.cites)


def seed_of(t):
    """The most cited paper."""
    top = g.citation_counts(t.cites).orderBy(F.desc("n"), "cited_id").limit(1)
    return top.select(F.col("cited_id").alias("paper_id"))


@query(
    "snowball",
    "cites",
    f"""
, start AS (SELECT cited_id AS id FROM {COUNTS} ORDER BY n DESC, cited_id LIMIT 1),
reach(id, lvl) AS (
  SELECT id, 0 FROM start
  UNION
  SELECT c.citing_id, r.lvl + 1 FROM cites c JOIN reach r ON r.id = c.cited_id)
SELECT id AS paper_id, min(lvl) AS level FROM reach GROUP BY id""",
)
def snowball(t):
    return g.snowball(t.cites, seed_of(t), blocks=t.adjacency)[0]


@query(
    "adjacency",
    "cites",
    """
SELECT cited_id, count(*) AS citing, min(citing_id) AS first_id, max(citing_id) AS last_id,
       sha256(string_agg(DISTINCT citing_id, ',' ORDER BY citing_id)) AS ids_sha256
FROM cites GROUP BY cited_id""",
)
def adjacency(t):
    """Each cited paper's list, put together again from its blocks."""
    ids = F.array_sort(F.flatten(F.collect_list("citing_ids")))
    return t.adjacency.groupBy("cited_id").agg(
        F.sum(F.size("citing_ids")).alias("citing"),
        F.min(F.col("citing_ids")[0]).alias("first_id"),
        F.max(F.element_at("citing_ids", -1)).alias("last_id"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
    )


@query(
    "in_degree",
    "nodes cites",
    f"SELECT paper_id, coalesce(n, 0) AS in_degree FROM nodes LEFT JOIN {COUNTS} ON cited_id = paper_id",
)
def in_degree(t):
    return g.in_degree(t.nodes, t.cites)


@query("graph_nodes", "graph_nodes", 'SELECT id, grp AS "group", title FROM graph_nodes')
def graph_nodes(t):
    return g.graph_tables(t.citations, t.hop2_edges)[0]


@query("graph_edges", "graph_edges", "SELECT source, target, kind FROM graph_edges")
def graph_edges(t):
    return g.graph_tables(t.citations, t.hop2_edges)[1]


def busiest_seed(t):
    rows = g.active_cluster(t.citations, t.hop2_edges)
    counts = rows.groupBy("citedPaperId").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "citedPaperId").limit(1)
    return top.select("citedPaperId").scalar()


@query(
    "graph_tables",
    "graph_nodes graph_edges",
    """
SELECT 'node' AS item, grp AS kind, count(*) AS count FROM graph_nodes GROUP BY grp
UNION ALL SELECT 'edge', kind, count(*) FROM graph_edges GROUP BY kind""",
)
def graph_tables(t):
    nodes, edges = g.graph_tables(t.citations, t.hop2_edges)
    n = F.count(F.lit(1)).alias("count")
    return (
        nodes.groupBy(F.col("group").alias("kind")).agg(n).select(F.lit("node").alias("item"), "kind", "count")
        .unionByName(edges.groupBy("kind").agg(n).select(F.lit("edge").alias("item"), "kind", "count"))
    )


TOUCHING = f"""(SELECT DISTINCT CASE WHEN source = {NODE} THEN target ELSE source END AS id
  FROM graph_edges WHERE source = {NODE} OR target = {NODE})"""


@query(
    "drill_down",
    "graph_nodes graph_edges",
    f"""
SELECT id, grp AS "group", title FROM graph_nodes
WHERE id IN (SELECT id FROM {TOUCHING}) AND
  CASE (SELECT max(grp) FROM graph_nodes WHERE id = {NODE}) WHEN 'seed' THEN grp = 'hop1'
       WHEN 'hop1' THEN grp IN ('hop2', 'author') WHEN 'hop2' THEN grp = 'author' ELSE false END""",
)
def drill_down(t):
    return g.drill_down(t.graph_nodes, t.graph_edges, busiest_seed(t))


@query(
    "two_hop_neighbourhood",
    "graph_edges",
    f"""
, ends AS (SELECT source AS id, target AS other FROM graph_edges
           UNION ALL SELECT target, source FROM graph_edges)
SELECT id, min(degree) AS degree FROM (
  SELECT {NODE} AS id, 0 AS degree UNION ALL SELECT id, 1 FROM {TOUCHING}
  UNION ALL SELECT other, 2 FROM ends WHERE id IN (SELECT id FROM {TOUCHING}))
GROUP BY id""",
)
def two_hop_neighbourhood(t):
    return g.two_hop_neighbourhood(t.graph_edges, busiest_seed(t))


@query(
    "property_filter",
    "graph_nodes graph_edges",
    """
SELECT 'node' AS item, id FROM graph_nodes WHERE grp IN ('author', 'hop1')
UNION ALL SELECT 'edge', id FROM (SELECT source AS id FROM graph_edges WHERE kind = 'writes'
                                  UNION SELECT target FROM graph_edges WHERE kind = 'writes')""",
)
def property_filter(t):
    nodes, edges = t.graph_nodes, t.graph_edges
    by_node = g.property_filter(nodes, edges, "node", "group", ["author", "hop1"])
    by_edge = g.property_filter(nodes, edges, "edge", "kind", ["writes"])
    return by_node.select(F.lit("node").alias("item"), "id").unionByName(
        by_edge.select(F.lit("edge").alias("item"), "id")
    )


@query(
    "edge_profile",
    "hop2_edges",
    """
SELECT count(*) AS rows, count(DISTINCT hop2_paper_id) AS hop2_papers,
       count(DISTINCT hop1_paper_id) AS hop1_papers
FROM hop2_edges""",
)
def edge_profile(t):
    return g.edge_profile(t.hop2_edges)


@query(
    "export_contexts",
    "clean2",
    """
SELECT citing_id, cited_id, arg_min(citation_text, rank) AS citation_text FROM (
  SELECT hop1_id AS citing_id, hop0_id AS cited_id, citation_text, 0 AS rank FROM clean1
  UNION ALL SELECT hop2_id, hop1_id, citation_text, 1 FROM clean2)
WHERE citation_text IS NOT NULL GROUP BY ALL""",
)
def export_contexts(t):
    return g.export_contexts(t.cleaned[1], t.cleaned[2])
