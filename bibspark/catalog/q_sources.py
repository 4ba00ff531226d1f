"""Source and sink queries: each lands derived data, reads it back, and returns it."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.catalog import payloads as pay
from bibspark.catalog.q_analytics import TOPICS
from bibspark.catalog.registry import query
from bibspark.functions import text as tx
from bibspark.operators import analytics, clean, metrics
from bibspark.session import new_path
from bibspark.sources import feeds, payloads, tables
from bibspark.streaming import ingest

FEED_AUTHORS = """array_to_string(list_transform(authors, lambda a:
         CASE WHEN contains(a, ' ') THEN split_part(a, ' ', 2) || ' ' || split_part(a, ' ', 1)
              ELSE a END), '|')"""


def arxiv_feed(t):
    return t.raw_docs.where("source = 'arxiv'").select(
        F.col("doc_id").cast("string").alias("id"),
        "title",
        "abstract",
        F.concat(F.col("year").cast("string"), F.lit("-11-26")).alias("update_date"),
        F.transform("authors", tx.split_name_list).alias("authors_parsed"),
    )


def s2_feed(t):
    return as_s2(t.raw_docs.where("source = 's2orc'"))


def as_s2(docs):
    return docs.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        "title",
        "abstract",
        "year",
        F.transform("authors", tx.split_name_struct).alias("authors"),
    )


def flat(df):
    return df.withColumn("authors", F.array_join("authors", "|"))


@query(
    "scan_arxiv",
    "raw_docs",
    f"SELECT title, abstract, {FEED_AUTHORS} AS authors, year, source FROM raw_docs WHERE source = 'arxiv'",
)
def scan_arxiv(t):
    path = new_path(t.spark, "arxiv_feed")
    tables.write_jsonl(arxiv_feed(t), path)
    return flat(feeds.scan_arxiv(t.spark, path))


@query(
    "scan_s2",
    "raw_docs",
    """
SELECT title, abstract, array_to_string(authors, '|') AS authors, year, source
FROM raw_docs WHERE source = 's2orc'""",
)
def scan_s2(t):
    live, sample = new_path(t.spark, "s2_live"), new_path(t.spark, "s2_feed")
    tables.write_jsonl(s2_feed(t), sample)
    return flat(feeds.scan_s2(t.spark, feeds.first_existing(t.spark, live, sample)))


@query(
    "atom_entries",
    "",
    """
SELECT CAST(doc_id AS VARCHAR) AS id, trim(split_part(text, chr(10), 1)) AS title,
       trim(replace(text, chr(10), ' ')) AS abstract, '2024-01-02' AS update_date,
       lang || ',' || source || ',' AS authors_parsed
FROM documents WHERE lang <> 'es'""",
)
def atom_entries(t):
    path = new_path(t.spark, "atom")
    entry = t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        # Entries without a date are skipped.
        F.when(F.col("lang") != "es", "2024-01-02T03:04:05Z").alias("published"),
        F.array(F.struct(F.concat_ws(" ", "source", "lang").alias("name"))).alias("author"),
    )
    entry.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    rows = feeds.atom_entries(t.spark, path)
    return rows.select(
        "id",
        F.trim("title").alias("title"),
        F.trim("abstract").alias("abstract"),
        "update_date",
        F.array_join(F.flatten("authors_parsed"), ",").alias("authors_parsed"),
    )


@query(
    "search_hits",
    "raw_docs",
    """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, title, abstract,
       CAST(CASE WHEN source = 'arxiv' THEN 2023 ELSE year END AS INTEGER) AS year,
       array_to_string(authors, '|') AS authors
FROM raw_docs""",
)
def search_hits(t):
    hit = F.struct(
        F.col("doc_id").cast("string").alias("paperId"),
        "title",
        "abstract",
        F.when(F.col("source") != "arxiv", F.col("year"))
        .when(F.col("year") % 2 == 0, 0)
        .alias("year"),
        F.transform("authors", lambda n: F.struct(n.alias("name"))).alias("authors"),
    )
    replies = t.raw_docs.select(F.to_json(F.struct(F.array(hit).alias("data"))).alias("payload"))
    hits = feeds.search_hits(replies)
    return flat(hits.withColumn("authors", tx.join_name_structs(F.col("authors"))))


@query(
    "name_split",
    "",
    """
SELECT p_partkey, p_name, split_part(p_name, ' ', 2) AS last, split_part(p_name, ' ', 1) AS first,
       p_type AS single_first, '' AS single_last
FROM part""",
)
def name_split(t):
    two = tx.split_name_struct(F.col("p_name"))
    one = tx.split_name_struct(F.col("p_type"))
    return t.part.select(
        "p_partkey", "p_name", two["last"].alias("last"), two["first"].alias("first"),
        one["first"].alias("single_first"), one["last"].alias("single_last"),
    )


@query(
    "query_ledger",
    "",
    """
SELECT 'pending' AS state, c_name AS query FROM customer
WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_mktsegment = 'MACHINERY')
UNION ALL
SELECT 'added', lower(c_name) FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0""",
)
def query_ledger(t):
    requested = t.customer.select(F.col("c_name").alias("query"), "c_acctbal")
    ledger = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.lower("c_name").alias("query"))
    pending = feeds.pending_queries(requested, ledger)
    added = feeds.ledger_entries(pending.where("c_acctbal > 0"), ledger)
    return pending.select(F.lit("pending").alias("state"), "query").unionByName(
        added.select(F.lit("added").alias("state"), "query")
    )


@query(
    "first_existing",
    "raw_docs",
    """
SELECT title, abstract, array_to_string(authors, '|') AS authors, year, 's2orc' AS source FROM raw_docs""",
)
def first_existing(t):
    """The sample stands in for a live feed that is not there."""
    live, sample = (new_path(t.spark, n) for n in ("live_feed", "sample_feed"))
    tables.write_jsonl(as_s2(t.raw_docs), sample)
    return flat(feeds.scan_s2(t.spark, feeds.first_existing(t.spark, live, sample)))


@query(
    "landing_append",
    "raw_docs",
    """
SELECT title, abstract, array_to_string(authors, '|') AS authors, year, source FROM (
  SELECT * REPLACE ('s2orc' AS source) FROM raw_docs UNION ALL SELECT * REPLACE ('s2orc' AS source) FROM raw_docs)""",
)
def landing_append(t):
    path = new_path(t.spark, "landing")
    for _ in range(2):
        feeds.landing_append(as_s2(t.raw_docs), path)
    return flat(feeds.scan_s2(t.spark, path))


INDEX_DIGEST = "SELECT '{0}' AS name, count(*) AS rows, min({1}) AS first, max({1}) AS last, sum({2})::BIGINT AS total FROM {0}"


@query(
    "load_indexes",
    "papers",
    f"""
, author_stats AS (SELECT author, year, count(*) AS n FROM (SELECT year, unnest(authors) AS author FROM papers) GROUP BY ALL),
temporal_topics AS (SELECT * FROM {TOPICS}),
listed AS (SELECT paper_id, unnest(authors) AS author FROM papers WHERE len(authors) > 1),
collaborations AS (
  SELECT x.author AS a, y.author AS b, count(*) AS n
  FROM listed x JOIN listed y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL),
rejected_papers AS (
  SELECT DISTINCT title, abstract, authors, year, source FROM raw_docs
  WHERE NOT (abstract IS NOT NULL AND year IS NOT NULL AND len(authors) > 0))
{" UNION ALL ".join(INDEX_DIGEST.format(*x) for x in [
    ("papers", "paper_id", "year"), ("author_stats", "author || ' ' || year", "n"),
    ("temporal_topics", "token || ' ' || year", "count"), ("collaborations", "a || ' ' || b", "n"),
    ("rejected_papers", "coalesce(title, '') || ' ' || year", "len(authors)")])}""",
)
def load_indexes(t):
    """A digest of every row of each of the five indexes as loaded."""
    base = new_path(t.spark, "index")
    tables.write_partitioned(t.papers, f"{base}/papers")
    tables.write_partitioned(analytics.author_stats(t.papers), f"{base}/author_stats", sort=["author"])
    tables.write_partitioned(analytics.temporal_topics(t.papers), f"{base}/temporal_topics", sort=["token"])
    listed = analytics.multi_author(t.papers).select("paper_id", F.explode("authors").alias("author"))
    tables.write_plain(analytics.collaborations(listed), f"{base}/collaborations")
    tables.write_plain(clean.rejected_papers(t.raw_papers), f"{base}/rejected_papers")
    loaded = tables.load_indexes(t.spark, base)
    text = {
        "papers": (F.col("paper_id"), F.col("year")),
        "author_stats": (F.concat_ws(" ", "author", "year"), F.col("paper_count")),
        "temporal_topics": (F.concat_ws(" ", "token", "year"), F.col("count")),
        "collaborations": (F.concat_ws(" ", "author1", "author2"), F.col("weight")),
        "rejected_papers": (F.concat_ws(" ", F.coalesce("title", F.lit("")), "year"), F.size("authors")),
    }
    digests = [
        loaded[name].agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"),
            F.sum(amount).cast("bigint").alias("total"),
        ).select(F.lit(name).alias("name"), "rows", "first", "last", "total")
        for name, (key, amount) in text.items()
    ]
    return reduce(DataFrame.unionByName, digests)


@query(
    "scan_hops",
    "seeds_meta hop1 hop2",
    """
SELECT 'hop0' AS layer, source_paper_id AS a, source_paper_id AS b, title, abstract, year FROM seeds_meta
UNION ALL SELECT 'hop1', hop1_id, hop0_id, hop1_title, hop1_abstract, hop1_year FROM hop1
UNION ALL SELECT 'hop2', hop2_id, hop1_id, hop2_title, hop2_abstract, hop2_year FROM hop2""",
)
def scan_hops(t):
    base = new_path(t.spark, "hops")
    tables.export_csv(t.seeds_meta, f"{base}/hop0_metadata_final_v2.csv")
    tables.export_csv(t.hop1.drop("seq"), f"{base}/hop1_final_dataset_rescued.csv")
    tables.export_csv(t.hop2.drop("seq"), f"{base}/hop2_final_dataset.csv")
    h0, h1, h2 = tables.scan_hops(t.spark, base)
    names = ["a", "b", "title", "abstract", "year"]
    rows = [
        h0.select("source_paper_id", "source_paper_id", "title", "abstract", "year"),
        h1.select("hop1_id", "hop0_id", "hop1_title", "hop1_abstract", "hop1_year"),
        h2.select("hop2_id", "hop1_id", "hop2_title", "hop2_abstract", "hop2_year"),
    ]
    parts = [r.toDF(*names).withColumn("layer", F.lit(f"hop{i}")) for i, r in enumerate(rows)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "scan_citations",
    "citations",
    "SELECT string, label, citing_paper, cited_paper, section, citing_title FROM citations",
)
def scan_citations(t):
    jsonl, parquet = new_path(t.spark, "citations_jsonl"), new_path(t.spark, "citations")
    tables.write_jsonl(t.citations.drop("seq"), jsonl)
    tables.write_plain(tables.scan_citations(t.spark, jsonl), parquet)
    return t.spark.read.schema(schemas.CITATIONS).parquet(parquet).select(
        "string",
        "label",
        F.col("citingPaperId").alias("citing_paper"),
        F.col("citedPaperId").alias("cited_paper"),
        F.col("sectionName").alias("section"),
        F.col("citingPaperTitle").alias("citing_title"),
    )


FLAT_SQL = """
SELECT cited_id AS hop1_paper_id, citing_id AS hop2_paper_id, title AS hop2_title, year AS hop2_year,
       abstract AS hop2_abstract,
       CASE WHEN p_type = 'SMALL' THEN '["' || p_brand || '"]'
            ELSE '["' || p_brand || '","' || p_type || '"]' END AS hop2_author_ids,
       context AS citation_context
FROM cites JOIN nodes ON paper_id = citing_id WHERE p_type <> 'PROMO'"""


@query("flatten_citations", "cites", FLAT_SQL)
def flatten_citations(t):
    return payloads.flatten_citations(pay.citation_json(t))


@query(
    "flatten_citations_strict",
    "cites",
    f"{FLAT_SQL} AND context IS NOT NULL AND abstract IS NOT NULL",
)
def flatten_citations_strict(t):
    return payloads.flatten_citations_strict(pay.citation_json(t))


@query("ingest_incremental", "cites", FLAT_SQL)
def ingest_incremental(t):
    base = new_path(t.spark, "ingest")
    landing, out, state = f"{base}/landing", f"{base}/edges", f"{base}/state"
    replies = pay.citation_json(t)
    late = F.col("hop1_id").endswith("7")
    # Two arrivals, each followed by a run; a third run finds nothing new.
    feeds.landing_append(replies.where(~late), landing)
    ingest.ingest_citations(t.spark, landing, out, state)
    feeds.landing_append(replies.where(late), landing)
    ingest.ingest_citations(t.spark, landing, out, state)
    ingest.ingest_citations(t.spark, landing, out, state)
    return ingest.read_edges(t.spark, out)


@query(
    "consolidate_chunks",
    "hop2_edges",
    """
SELECT hop1_paper_id, hop2_paper_id, hop2_title, hop2_year, citation_context FROM (
  SELECT *, row_number() OVER (PARTITION BY hop1_paper_id, hop2_paper_id ORDER BY seq,
            citation_context NULLS FIRST) AS rn FROM hop2_edges)
WHERE rn = 1""",
)
def consolidate_chunks(t):
    chunks = t.hop2_edges.select(
        "hop1_paper_id", "hop2_paper_id", "hop2_title", "hop2_year", "citation_context", "seq"
    )
    return payloads.consolidate_chunks(chunks, ["seq"]).drop("seq")


@query(
    "flatten_authors",
    "nodes",
    """
SELECT paper_id, CAST(position AS INTEGER) AS position, author_id, coalesce(author_id, 'Unknown') AS author_name
FROM (
  SELECT paper_id, 0 AS position, p_brand AS author_id FROM nodes WHERE p_type <> 'PROMO'
  UNION ALL SELECT paper_id, 1, CASE WHEN p_type <> 'SMALL' THEN p_type END FROM nodes
            WHERE p_type <> 'PROMO')""",
)
def flatten_authors(t):
    def listed(*names):
        return F.array(*[F.struct(n.alias("authorId"), n.alias("name")) for n in names])

    kind = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    entry = F.when(F.col("p_type") != "PROMO", F.struct(listed(F.col("p_brand"), kind).alias("authors")))
    # One request of two ids per paper: the second id answers null.
    replies = t.nodes.select(
        F.array("paper_id", F.concat("paper_id", F.lit("x"))).alias("ids"),
        F.to_json(F.array(entry, F.lit(None).cast(
            "struct<authors:array<struct<authorId:string,name:string>>>"))).alias("payload"),
    )
    return payloads.flatten_authors(replies)


@query(
    "first_hit_openalex",
    "nodes",
    """
SELECT paper_id, 'oa_A' || CAST(p_size AS VARCHAR) AS author_id,
       CASE WHEN p_size <> 5 THEN p_brand ELSE 'Unknown' END AS author_name
FROM nodes WHERE p_type NOT IN ('SMALL', 'LARGE')""",
)
def first_hit_openalex(t):
    return payloads.first_hit_openalex(pay.openalex_json(t))


@query(
    "openalex_abstracts",
    "nodes",
    """
SELECT paper_id AS source_paper_id,
       coalesce(array_to_string(list_transform(list_zip(w, range(len(w))),
                lambda x: x[1] || '_' || CAST(x[2] AS VARCHAR)), ' '), '') AS abstract, year
FROM (SELECT paper_id, year, list_filter(string_split(coalesce(abstract, ''), ' '), lambda x: x <> '') AS w
      FROM nodes WHERE p_type <> 'LARGE')""",
)
def openalex_abstracts(t):
    return payloads.openalex_abstracts(pay.openalex_json(t))


@query(
    "first_hit_crossref",
    "",
    """
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_id,
       CASE WHEN p_type = 'PROMO' THEN 'cr_0000-' || p_brand
            ELSE 'cr_' || replace(lower(p_name), ' ', '_') || '_0' END AS author_id,
       p_name AS author_name
FROM part
UNION ALL
SELECT 'P' || CAST(p_partkey AS VARCHAR),
       'cr_' || CASE WHEN p_size <> 3 THEN lower(p_brand) ELSE 'unknown' END || '_1',
       CASE WHEN p_size <> 3 THEN p_brand ELSE 'Unknown' END
FROM part""",
)
def first_hit_crossref(t):
    return payloads.first_hit_crossref(pay.crossref_json(t))


@query(
    "crossref_abstracts",
    "nodes",
    """
SELECT paper_id AS source_paper_id, coalesce(abstract, '') AS abstract,
       CASE WHEN p_size <> 9 THEN year END AS year
FROM nodes""",
)
def crossref_abstracts(t):
    return payloads.crossref_abstracts(pay.crossref_json(t))


@query(
    "batch_metadata",
    "nodes",
    """
SELECT paper_id, title, coalesce(year, 2020) AS year, abstract, CAST(0 AS INTEGER) AS authors
FROM nodes WHERE p_type <> 'PROMO'""",
)
def batch_metadata(t):
    entry = F.when(
        F.col("p_type") != "PROMO",
        F.struct(F.col("paper_id").alias("paperId"), "title", "year", "abstract"),
    )
    replies = t.nodes.select(F.to_json(F.array(entry)).alias("payload"))
    rows = payloads.batch_metadata(replies, default_year=2020)
    return rows.withColumn("authors", F.size("authors"))


@query(
    "write_partitioned",
    "papers",
    "SELECT paper_id, title, abstract, array_to_string(authors, '|') AS authors, source, year FROM papers",
)
def write_partitioned(t):
    path = new_path(t.spark, "papers_by_year")
    tables.write_partitioned(t.papers, path, sort=["paper_id"])
    return flat(t.spark.read.schema(schemas.PAPERS).parquet(path))


@query(
    "write_plain",
    "authorship",
    """
SELECT x.author AS author1, y.author AS author2, count(*) AS weight
FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL""",
)
def write_plain(t):
    path = new_path(t.spark, "collaborations")
    tables.write_plain(analytics.collaborations(t.authorship), path)
    return t.spark.read.schema(schemas.COLLABORATIONS).parquet(path)


@query(
    "export_csv",
    "predictions",
    """
SELECT cited_id AS cited_paper_id, round(sum(semantic_weight), 6) AS total_semantic_impact,
       count(*) AS raw_citation_count
FROM predictions GROUP BY cited_id""",
)
def export_csv(t):
    path = new_path(t.spark, "paper_impact_csv")
    impact = metrics.paper_impact(t.predictions)
    tables.export_csv(
        impact.withColumn("total_semantic_impact", F.round("total_semantic_impact", 6)), path
    )
    return tables.read_csv(
        t.spark, path, "cited_paper_id string, total_semantic_impact double, raw_citation_count bigint"
    )


@query(
    "write_jsonl",
    "",
    "SELECT page_id, url, html FROM pages",
)
def write_jsonl(t):
    path = new_path(t.spark, "pages_jsonl")
    tables.write_jsonl(t.pages, path)
    return t.spark.read.schema("page_id bigint, url string, html string").json(path)
