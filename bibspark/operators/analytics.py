"""Author, topic and collaboration analytics over the paper index."""

from __future__ import annotations

import math

from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions import text as tx
from bibspark.session import land
from bibspark.skew import key_counts, rows_per_task, spread_join

HASH_BUCKETS = 5000

# Papers of more distinct authors are paired in blocks of this size.
BLOCK = 1000

# So many of the most frequent terms, at most, are broadcast with their weight.
COMMON_TERMS = 200_000


def explode_authors(papers: DataFrame) -> DataFrame:
    """One row per listed author; a name listed twice gives two rows."""
    return papers.select("paper_id", "year", F.explode("authors").alias("author"))


def author_stats(papers: DataFrame) -> DataFrame:
    return (
        explode_authors(papers)
        .groupBy("author", "year")
        .agg(F.count(F.lit(1)).alias("paper_count"))
    )


def top_authors(stats: DataFrame, k: int | None = None) -> DataFrame:
    ranked = (
        stats.groupBy("author")
        .agg(F.sum("paper_count").alias("total_papers"))
        .orderBy(F.desc("total_papers"), "author")
    )
    return ranked if k is None else ranked.limit(k)


def author_activity(stats: DataFrame, author: str) -> DataFrame:
    return stats.where(F.col("author") == author).select("year", "paper_count").orderBy("year")


def author_list(stats: DataFrame) -> DataFrame:
    return stats.select("author").distinct().orderBy("author")


def author_total(stats: DataFrame, author: str) -> DataFrame:
    return stats.where(F.col("author") == author).agg(F.sum("paper_count").alias("total_papers"))


def authors_with_n(stats: DataFrame, n: int = 1) -> DataFrame:
    return stats.where(F.col("paper_count") == n)


def _counted(rows: DataFrame, words: Column) -> DataFrame:
    """`rows` with `terms`, the different words of a row, sorted, as (token, n).

    Counted inside the row: equal words lie side by side once sorted. Every step is a column
    of its own, as a lambda would work out an expression anew for each element.
    """
    rows = rows.withColumn("_words", F.sort_array(words))
    w, e = F.col("_words"), F.col("_ends")
    # places, from 1, at which a run of equal words ends
    places = F.transform(w, lambda x, i: i + 1)
    rows = rows.withColumn("_ends", F.filter(places, lambda i: ~F.get(w, i).eqNullSafe(F.get(w, i - 1))))

    def term(end: Column, i: Column) -> Column:
        n = (end - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("long")
        return F.struct(F.get(w, end - 1).alias("token"), n.alias("n"))

    return rows.withColumn("terms", F.transform(e, term)).drop("_words", "_ends")


def tokenize(papers: DataFrame, counted: bool = False) -> DataFrame:
    """One row per token of the lower-cased abstract, split at single spaces.

    `counted` gives one row per different token of a row of papers, with its count `n`,
    for which nothing is gathered or shuffled.
    """
    tokens = tx.tokens(F.col("abstract"))
    if not counted:
        return papers.select("paper_id", "year", F.explode(tokens).alias("token"))
    terms = _counted(papers.select("paper_id", "year", "abstract"), tokens)
    # the outer form: for the plain one Spark would count words once more, to filter on their number
    return terms.select("paper_id", "year", F.inline_outer("terms")).where(F.col("token").isNotNull())


def filter_tokens(tokens: DataFrame, stopwords: list[str] = tx.STOPWORDS) -> DataFrame:
    return tokens.where(tx.is_topic(F.col("token"), stopwords))


def doc_tokens(papers: DataFrame, stopwords: list[str] = tx.STOPWORDS) -> DataFrame:
    """Topic words per paper in text order; papers without any are left out.

    Filtered inside the row: no explode and no shuffle to gather them again.
    """
    return papers.select(
        "paper_id", "year", tx.topic_tokens(F.col("abstract"), stopwords).alias("tokens")
    ).where(F.size("tokens") > 0)


def hashing_tf(docs: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    return HashingTF(inputCol="tokens", outputCol="tf_features", numFeatures=buckets).transform(docs)


def tfidf_features(tf: DataFrame) -> DataFrame:
    """Hashed TF-IDF with idf = ln((n+1)/(df+1)); the model is one vector of the buckets."""
    return IDF(inputCol="tf_features", outputCol="tfidf_features").fit(tf).transform(tf)


def _term_counts(papers: DataFrame, stopwords: list[str]) -> DataFrame:
    """(paper_id, first, terms), landed: topic words of a paper as (token, n), a token once for each id.

    `first` adds up to the rows with any topic word. Only ids that come in several rows are grouped.
    """
    rows = _counted(papers.select("paper_id", "abstract"), tx.topic_tokens(F.col("abstract"), stopwords))
    terms = land(rows.select("paper_id", (F.size("terms") > 0).cast("long").alias("first"), "terms"), "term_counts")
    repeated = land(key_counts(terms, ["paper_id"]).where("_n > 1").select(F.col("paper_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return terms
    same = F.col("paper_id").eqNullSafe(F.col("_id"))
    words = terms.join(repeated, same, "left_semi").select("paper_id", F.posexplode("terms").alias("pos", "x"))
    merged = words.groupBy("paper_id", F.col("x.token").alias("token")).agg(
        F.sum("x.n").alias("n"), F.count_if(F.col("pos") == 0).alias("first")
    )
    merged = merged.select("paper_id", "first", F.array(F.struct("token", "n")).alias("terms"))
    return land(terms.join(repeated, same, "left_anti").unionByName(merged), "merged_counts")


def _least_common(df: DataFrame, most: int) -> tuple[int | None, int]:
    """The least df of common terms, which are at most `most`, and the rows of all other terms."""
    sizes = df.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    # few rows: there are no more different counts than the root of twice the rows
    sizes = sizes.withColumn("upto", F.sum("terms").over(Window.orderBy(F.desc("df"))))
    common = F.col("upto") <= most
    found = sizes.agg(
        F.min(F.when(common, F.col("df"))).alias("cut"),
        F.sum(F.when(~common, F.col("df") * F.col("terms"))).alias("rest"),
    ).first()
    return found["cut"], found["rest"] or 0


def tfidf(papers: DataFrame, stopwords: list[str] = tx.STOPWORDS, common: int = COMMON_TERMS) -> DataFrame:
    """Exact-token TF-IDF: (paper_id, token, tf, tfidf).

    Words are counted inside the row and landed by paper, so texts are split once for the three reads
    of them and no row of a word is shuffled to count it. The weights of the `common` most
    frequent terms are broadcast; rows of the rest, a minor part, are joined by token, in as many
    tasks as their number needs.
    """
    terms = _term_counts(papers, stopwords)
    words = terms.select("paper_id", F.inline("terms")).withColumnRenamed("n", "tf")
    df = land(words.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "term_papers")
    n = terms.agg(F.sum("first"))
    idf = df.withColumn("idf", F.log((n.scalar() + 1) / (F.col("df") + 1)))
    cut, rest = _least_common(df, common)
    found = []
    if cut is not None:
        weights = F.broadcast(idf.where(F.col("df") >= cut))
        found.append(words.join(weights, "token"))
        words = words.join(F.broadcast(df.where(F.col("df") >= cut).select("token")), "token", "left_anti")
        idf, df = idf.where(F.col("df") < cut), df.where(F.col("df") < cut)
    if rest or not found:
        tasks = math.ceil(rest / rows_per_task(words))
        if tasks > int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            words = words.repartition(tasks, "token")
        sizes = df.select("token", F.col("df").alias("_n"))
        found.append(spread_join(words, idf, "token", sizes=sizes))
    weighed = [x.select("paper_id", "token", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")) for x in found]
    return weighed[0] if len(weighed) == 1 else weighed[0].unionByName(weighed[1])


def temporal_topics(papers: DataFrame, stopwords: list[str] = tx.STOPWORDS) -> DataFrame:
    return (
        filter_tokens(tokenize(papers), stopwords)
        .groupBy("year", "token")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_topics_year(topics: DataFrame, year: int, k: int = 10) -> DataFrame:
    return topics.where(F.col("year") == year).orderBy(F.desc("count"), "token").limit(k)


def keyword_trend(topics: DataFrame, keyword: str) -> DataFrame:
    return topics.where(F.col("token") == keyword.lower()).select("year", "count").orderBy("year")


def multi_author(papers: DataFrame) -> DataFrame:
    return papers.where(F.size("authors") > 1).select("paper_id", "authors")


def _block_pairs(rows: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """Pairs within the papers of `large` (paper_id, authors).

    A paper's authors are dealt into blocks and every pair of blocks is a join key
    of its own, so the pairs of one paper are made by as many tasks as it has
    block pairs. Dealing itself is linear in the distinct authors of a paper.
    """
    blocks = F.ceil(F.col("authors") / F.lit(block)).cast("int")
    dealt = spread_join(rows, large, "paper_id", sizes=large.withColumnRenamed("authors", "_n")).select(
        "paper_id", "author", "m", blocks.alias("blocks"),
        F.pmod(F.xxhash64("author"), blocks).cast("int").alias("b"),
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select(
        "paper_id", F.col("author").alias("author1"), F.col("m").alias("m1"), F.col("b").alias("i"),
        every.alias("j"),
    )
    right = dealt.select(
        "paper_id", F.col("author").alias("author2"), F.col("m").alias("m2"), every.alias("i"),
        F.col("b").alias("j"),
    )
    return left.join(right, ["paper_id", "i", "j"])


def coauthor_pairs(authorship: DataFrame, block: int = BLOCK) -> DataFrame:
    """(paper_id, author1, author2, n) with author1 < author2.

    `n` is how many pairs the self-join of the author rows gives, since a name
    may be listed more than once. Rows are first reduced to distinct authors, so
    a paper of at most `block` authors is a bounded group and joined as it is;
    larger papers are joined block by block.
    """
    rows = authorship.groupBy("paper_id", "author").agg(F.count(F.lit(1)).alias("m"))
    counts = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("authors"))
    large = land(counts.where(F.col("authors") > block), "large_papers")
    sizes = large.withColumnRenamed("authors", "_n")
    small = spread_join(rows, large.select("paper_id"), "paper_id", "left_anti", sizes=sizes)
    a = small.select("paper_id", F.col("author").alias("author1"), F.col("m").alias("m1"))
    b = small.select("paper_id", F.col("author").alias("author2"), F.col("m").alias("m2"))
    pairs = a.join(b, "paper_id")
    blocks = _block_pairs(rows, large, block)
    return (
        pairs.unionByName(blocks.select(*pairs.columns))
        .where(F.col("author1") < F.col("author2"))
        .select("paper_id", "author1", "author2", (F.col("m1") * F.col("m2")).alias("n"))
    )


def collaborations(authorship: DataFrame, block: int = BLOCK) -> DataFrame:
    """(author1, author2, weight): pairs over all papers."""
    return (
        coauthor_pairs(authorship, block)
        .groupBy("author1", "author2")
        .agg(F.sum("n").alias("weight"))
    )


def top_collabs(collabs: DataFrame, k: int = 10) -> DataFrame:
    return collabs.orderBy(F.desc("weight"), "author1", "author2").limit(k)


def collab_authors(collabs: DataFrame) -> DataFrame:
    ends = collabs.select(F.explode(F.array("author1", "author2")).alias("author"))
    return ends.distinct().orderBy("author")


def ego_network(collabs: DataFrame, author: str, k: int = 50) -> DataFrame:
    touching = (F.col("author1") == author) | (F.col("author2") == author)
    return top_collabs(collabs.where(touching), k)


def ego_edges(edges: DataFrame, author: str) -> DataFrame:
    """(source, target, weight): from the author to the other end of each edge."""
    other = F.when(F.col("author1") == author, F.col("author2")).otherwise(F.col("author1"))
    return edges.select(F.lit(author).alias("source"), other.alias("target"), "weight")


def ego_nodes(edges: DataFrame, author: str) -> DataFrame:
    """(node, role): the author and every collaborator; empty for an author without edges."""
    return (
        ego_edges(edges, author)
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("source").alias("node"), F.lit("center").alias("role")),
                    F.struct(F.col("target").alias("node"), F.lit("collaborator").alias("role")),
                )
            ).alias("x")
        )
        .select("x.*")
        .distinct()
    )


def search_abstract(papers: DataFrame, keyword: str) -> DataFrame:
    return papers.where(F.col("abstract").contains(keyword.lower()))


def papers_by_year(papers: DataFrame, year: int) -> DataFrame:
    return papers.where(F.col("year") == year)


def inspect_rejects(rejected: DataFrame) -> DataFrame:
    """Title, reason and source of each rejected row, with the total."""
    total = rejected.agg(F.count(F.lit(1)))
    return rejected.select("title", "reason", "source", total.scalar().alias("total_rejected"))


def source_counts_sql(papers: DataFrame) -> DataFrame:
    return papers.sparkSession.sql(
        "SELECT source, count(*) AS source_count FROM {papers} GROUP BY source", papers=papers
    )
