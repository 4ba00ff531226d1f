"""Author, topic and collaboration queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.catalog.registry import query
from pyspark.ml.functions import vector_to_array

from bibspark.functions.text import STOPWORDS
from bibspark.operators import analytics as a
from bibspark.operators import clean, search
from bibspark.session import new_path
from bibspark.sources import feeds
from bibspark.streaming import refresh

AUTHOR = "A12"
COLLABORATOR = "Supplier#000000007"
KEYWORD = "Thatin"
YEAR = 2023

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
STATS = "(SELECT author, year, count(*) AS paper_count FROM (SELECT year, unnest(authors) AS author FROM papers) GROUP BY ALL)"
TOKENS = "(SELECT paper_id, year, unnest(string_split(lower(abstract), ' ')) AS token FROM papers)"
WORDS = f"(SELECT * FROM {TOKENS} WHERE token NOT IN ({STOP_SQL}) AND length(token) > 3)"
TOPICS = f"(SELECT year, token, count(*) AS count FROM {WORDS} GROUP BY ALL)"
COLLABS = """(SELECT x.author AS author1, y.author AS author2, count(*) AS weight
  FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL)"""


@query(
    "explode_authors", "papers", "SELECT paper_id, year, unnest(authors) AS author FROM papers"
)
def explode_authors(t):
    return a.explode_authors(t.papers)


@query("author_stats", "papers", f"SELECT * FROM {STATS}")
def author_stats(t):
    return a.author_stats(t.papers)


@query(
    "author_stats_orders",
    "authorship",
    "SELECT author, year, count(*) AS paper_count FROM authorship GROUP BY ALL",
)
def author_stats_orders(t):
    return t.authorship.groupBy("author", "year").agg(F.count(F.lit(1)).alias("paper_count"))


@query(
    "top_authors",
    "papers",
    f"SELECT author, CAST(sum(paper_count) AS BIGINT) AS total_papers FROM {STATS} GROUP BY author",
)
def top_authors(t):
    return a.top_authors(a.author_stats(t.papers))


@query(
    "author_activity", "papers", f"SELECT year, paper_count FROM {STATS} WHERE author = '{AUTHOR}'"
)
def author_activity(t):
    return a.author_activity(a.author_stats(t.papers), AUTHOR)


@query(
    "tokenize", "papers", f"SELECT year, token, count(*) AS n FROM {TOKENS} GROUP BY ALL"
)
def tokenize(t):
    return a.tokenize(t.papers).groupBy("year", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_tokens",
    "papers",
    f"SELECT paper_id, token, count(*) AS n FROM {WORDS} GROUP BY ALL",
)
def filter_tokens(t):
    """Papers are one row per id, so the counts of a row are those of its paper."""
    return a.filter_tokens(a.tokenize(t.papers, counted=True)).select("paper_id", "token", "n")


@query(
    "doc_tokens",
    "papers",
    f"""
SELECT paper_id, year, array_to_string(tokens, ' ') AS tokens FROM (
  SELECT paper_id, year, list_filter(string_split(lower(abstract), ' '),
         lambda w: length(w) > 3 AND NOT list_contains([{STOP_SQL}], w)) AS tokens FROM papers)
WHERE len(tokens) > 0""",
)
def doc_tokens(t):
    return a.doc_tokens(t.papers).withColumn("tokens", F.array_join("tokens", " "))


def _values(vector):
    return vector_to_array(F.col(vector))


@query(
    "hashing_tf",
    "papers",
    f"""
SELECT paper_id, year, {a.HASH_BUCKETS} AS buckets, CAST(count(*) AS DOUBLE) AS tokens
FROM {WORDS} GROUP BY paper_id, year""",
)
def hashing_tf(t):
    """The counts in a paper's buckets add up to its topic words."""
    v = _values("tf_features")
    return a.hashing_tf(a.doc_tokens(t.papers)).select(
        "paper_id", "year", F.size(v).alias("buckets"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("tokens")
    )


@query(
    "tfidf_features",
    "papers",
    f"""
SELECT DISTINCT paper_id, year, {a.HASH_BUCKETS} AS buckets, true AS same_support FROM {WORDS}""",
)
def tfidf_features(t):
    """A bucket weighs something only if it counts something, and all weights are at least 0."""
    tf = a.hashing_tf(a.doc_tokens(t.papers))
    pairs = F.arrays_zip(_values("tf_features").alias("n"), _values("tfidf_features").alias("w"))
    same = F.forall(pairs, lambda p: (p["w"] >= 0) & ((p["n"] > 0) | (p["w"] == 0)))
    return a.tfidf_features(tf).select(
        "paper_id", "year", F.size(pairs).alias("buckets"), same.alias("same_support")
    )


@query(
    "tfidf",
    "papers",
    f"""
, tf AS (SELECT paper_id, token, count(*) AS tf FROM {WORDS} GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT paper_id, token, tf,
       round(tf * ln(((SELECT count(DISTINCT paper_id) FROM tf) + 1) / (df + 1)), 6) AS tfidf
FROM tf JOIN df USING (token)""",
)
def tfidf(t):
    return a.tfidf(t.papers).withColumn("tfidf", F.round("tfidf", 6))


@query("temporal_topics", "papers", f"SELECT * FROM {TOPICS}")
def temporal_topics(t):
    return a.temporal_topics(t.papers)


@query(
    "top_topics_year",
    "papers",
    f"SELECT * FROM {TOPICS} WHERE year = {YEAR} ORDER BY count DESC, token LIMIT 10",
)
def top_topics_year(t):
    return a.top_topics_year(a.temporal_topics(t.papers), YEAR)


@query(
    "keyword_trend",
    "papers",
    f"SELECT year, count FROM {TOPICS} WHERE token = lower('{KEYWORD}')",
)
def keyword_trend(t):
    return a.keyword_trend(a.temporal_topics(t.papers), KEYWORD)


@query(
    "multi_author",
    "papers",
    "SELECT paper_id, array_to_string(authors, '|') AS authors FROM papers WHERE len(authors) > 1",
)
def multi_author(t):
    return a.multi_author(t.papers).withColumn("authors", F.array_join("authors", "|"))


@query(
    "coauthor_pairs",
    "authorship",
    """
SELECT x.paper_id, x.author AS author1, y.author AS author2, count(*) AS n
FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL""",
)
def coauthor_pairs(t):
    return a.coauthor_pairs(t.authorship)


@query("collaborations", "authorship", f"SELECT * FROM {COLLABS}")
def collaborations(t):
    return a.collaborations(t.authorship)


@query(
    "collaborations_papers",
    "papers",
    """
, authorship AS (SELECT paper_id, unnest(authors) AS author FROM papers WHERE len(authors) > 1)
SELECT x.author AS author1, y.author AS author2, count(*) AS weight
FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL""",
)
def collaborations_papers(t):
    listed = a.multi_author(t.papers).select("paper_id", F.explode("authors").alias("author"))
    return a.collaborations(listed)


@query(
    "top_collabs",
    "authorship",
    f"SELECT * FROM {COLLABS} ORDER BY weight DESC, author1, author2 LIMIT 10",
)
def top_collabs(t):
    return a.top_collabs(a.collaborations(t.authorship))


@query(
    "search_abstract",
    "papers",
    f"SELECT paper_id, title, year, source FROM papers WHERE contains(abstract, lower('{KEYWORD}'))",
)
def search_abstract(t):
    return a.search_abstract(t.papers, KEYWORD).select("paper_id", "title", "year", "source")


# A word, a part of words, a rare string, one that no abstract has, and needles of two letters and one.
NEEDLES = [KEYWORD.lower(), "tion ", "xplore", "zzzzzz", "é ", "ñ", "q"]


@query(
    "search_index",
    "papers",
    f"""
SELECT needle, paper_id, title, year, source
FROM papers, (SELECT unnest({NEEDLES}) AS needle) WHERE contains(abstract, needle)""",
)
def search_index(t):
    """Papers found for each needle by the posting index."""
    found = [search.search(t.spark, t.search_index, x).withColumn("needle", F.lit(x)) for x in NEEDLES]
    return reduce(DataFrame.unionByName, found).select("needle", "paper_id", "title", "year", "source")


@query(
    "posting_lists",
    "papers",
    """
, places AS (SELECT paper_id, abstract, unnest(range(greatest(length(abstract) - 2, 1))) AS i
             FROM papers WHERE abstract <> '')
SELECT gram, count(*) AS papers, min(paper_id) AS first_id, max(paper_id) AS last_id
FROM (SELECT DISTINCT paper_id, substr(abstract, i + 1, 3) AS gram FROM places) GROUP BY gram""",
)
def posting_lists(t):
    """Every gram's list read back: how many papers, the first and the last of them."""
    path, spark = t.search_index, t.spark
    places = search.places(spark.read.parquet(f"{path}/postings"))
    size = spark.read.parquet(f"{path}/settings").select("block_papers").scalar()
    number = F.col("block") * size + F.col("place")
    # papers are numbered in the order of their ids: the ids of the first and last are looked up for each gram alone
    lists = places.groupBy("gram").agg(
        F.count(F.lit(1)).alias("papers"), F.min(number).alias("first"), F.max(number).alias("last")
    )
    papers = spark.read.parquet(f"{path}/papers").select("number", "paper_id")
    for end in ("first", "last"):
        lists = lists.join(papers.select(F.col("number").alias(end), F.col("paper_id").alias(f"{end}_id")), end)
    return lists.select("gram", "papers", "first_id", "last_id")


@query("author_list", "papers", f"SELECT DISTINCT author FROM {STATS}")
def author_list(t):
    return a.author_list(a.author_stats(t.papers))


@query(
    "author_total",
    "papers",
    f"SELECT CAST(sum(paper_count) AS BIGINT) AS total_papers FROM {STATS} WHERE author = '{AUTHOR}'",
)
def author_total(t):
    return a.author_total(a.author_stats(t.papers), AUTHOR)


@query(
    "collab_authors",
    "authorship",
    f"SELECT author1 AS author FROM {COLLABS} UNION SELECT author2 FROM {COLLABS}",
)
def collab_authors(t):
    return a.collab_authors(a.collaborations(t.authorship))


EGO = f"""(SELECT * FROM {COLLABS} WHERE author1 = '{COLLABORATOR}' OR author2 = '{COLLABORATOR}'
  ORDER BY weight DESC, author1, author2 LIMIT 50)"""


@query("ego_network", "authorship", f"SELECT * FROM {EGO}")
def ego_network(t):
    return a.ego_network(a.collaborations(t.authorship), COLLABORATOR)


@query(
    "ego_nodes",
    "authorship",
    f"""
SELECT DISTINCT '{COLLABORATOR}' AS node, 'center' AS role FROM {EGO}
UNION SELECT CASE WHEN author1 = '{COLLABORATOR}' THEN author2 ELSE author1 END, 'collaborator' FROM {EGO}""",
)
def ego_nodes(t):
    return a.ego_nodes(a.ego_network(a.collaborations(t.authorship), COLLABORATOR), COLLABORATOR)


@query(
    "ego_edges",
    "authorship",
    f"""
SELECT '{COLLABORATOR}' AS source, weight,
       CASE WHEN author1 = '{COLLABORATOR}' THEN author2 ELSE author1 END AS target FROM {EGO}""",
)
def ego_edges(t):
    return a.ego_edges(a.ego_network(a.collaborations(t.authorship), COLLABORATOR), COLLABORATOR)


@query(
    "papers_by_year", "papers", f"SELECT paper_id, title, year, source FROM papers WHERE year = {YEAR}"
)
def papers_by_year(t):
    return a.papers_by_year(t.papers, YEAR).select("paper_id", "title", "year", "source")


@query("authors_with_n", "papers", f"SELECT * FROM {STATS} WHERE paper_count = 1")
def authors_with_n(t):
    return a.authors_with_n(a.author_stats(t.papers), 1)


REJECTS = """(SELECT DISTINCT title, abstract, array_to_string(authors, '|') AS authors, year, source
  FROM raw_docs WHERE NOT (abstract IS NOT NULL AND year IS NOT NULL AND len(authors) > 0))"""


@query(
    "inspect_rejects",
    "raw_docs",
    f"""
SELECT title, 'failed_validation' AS reason, source, (SELECT count(*) FROM {REJECTS}) AS total_rejected
FROM {REJECTS}""",
)
def inspect_rejects(t):
    return a.inspect_rejects(clean.rejected_papers(t.raw_papers))


@query(
    "sql_source_counts",
    "papers",
    "SELECT source, count(*) AS source_count FROM papers GROUP BY source",
)
def sql_source_counts(t):
    return a.source_counts_sql(t.papers)


# ---- indexes refreshed by a stream ----------------------------------------
def refreshed(t, name):
    """The index after three arrivals, each followed by a run; later ones bring earlier papers again."""
    base = new_path(t.spark, "refresh")
    landing, out, state = f"{base}/landing", f"{base}/index", f"{base}/state"
    arrival = F.pmod(F.crc32(F.col("paper_id")), F.lit(3))
    for k in range(3):
        feeds.landing_append(t.papers.where(arrival <= k), landing)
        refresh.refresh(t.spark, landing, out, state, compact_every=2)
    return refresh.read_index(t.spark, out, name)


@query("refreshed_author_stats", "papers", f"SELECT * FROM {STATS}")
def refreshed_author_stats(t):
    return refreshed(t, "author_stats")


@query("refreshed_topics", "papers", f"SELECT * FROM {TOPICS}")
def refreshed_topics(t):
    return refreshed(t, "temporal_topics")


@query(
    "refreshed_collaborations",
    "papers",
    """
, authorship AS (SELECT paper_id, unnest(authors) AS author FROM papers WHERE len(authors) > 1)
SELECT x.author AS author1, y.author AS author2, count(*) AS weight
FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL""",
)
def refreshed_collaborations(t):
    return refreshed(t, "collaborations")
