"""Papers matched with catalogue records by title: an exact set-similarity join.

Titles are compared as sets of words, by the share of common words among all (Jaccard). Two sets
whose share is at least t have sizes within a factor t of each other, and share a word among
the first n - ceil(t * n) + 1 words of each, whatever order all words are put in. With the rarest
words first, those prefixes hold rare words, so the join meets few pairs that fail, and
none that passes is missed. Equal sets are joined once, for all titles that have them; a word
that is in very many prefixes all the same is dealt over tasks (`spread_join`).

Titles without a word match nothing. Where many titles have the same words, the pairs of all rows grow
with the square of their copies: `title_classes` gives one row a word set, `match_titles` joins those,
and `class_matches` carries counts and smallest ids over to the rows, without a pair for each two copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.session import land
from bibspark.skew import spread_join


def title_words(title: Column) -> Column:
    """The distinct words of a title in lower case: runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def similarity(a: Column, b: Column) -> Column:
    """Share of common words of two arrays of distinct words; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))


def accept_hits(hits: DataFrame, title: str, found_title: str, least: float) -> DataFrame:
    """The rows of `hits` whose found title is similar enough to the title that was asked for."""
    return hits.where(similarity(title_words(F.col(title)), title_words(F.col(found_title))) >= least)


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """(key, words): sorted, so that equal sets are equal arrays."""
    words = F.sort_array(title_words(F.col("title")))
    return rows.select(F.col(key), words.alias("words")).where(F.size("words") > 0)


def _prefixes(sets: DataFrame, ranks: DataFrame, least: float) -> DataFrame:
    """(token, words, n): every distinct set under each of its prefix words, rarest first."""
    each = sets.select("words", F.explode("words").alias("token"))
    ranked = spread_join(each, ranks, "token", rows="n").groupBy("words").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("order")
    )
    n = F.size("words")
    # a hair less than t * n, so that rounding never shortens a prefix
    length = n - F.ceil(n * F.lit(least) - 1e-9) + 1
    first = F.transform(F.slice("order", F.lit(1), length.cast("int")), lambda x: x["token"])
    return ranked.select("words", n.alias("size"), F.explode(first).alias("token"))


def match_titles(papers: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """(paper_id, record_id, similarity) of all pairs of `papers` (paper_id, title) and `records`
    (record_id, title) whose titles' similarity is at least `least` (above 0)."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    left, right = land(_sets(papers, "paper_id"), "paper_words"), land(_sets(records, "record_id"), "record_words")
    sets_l, sets_r = left.select("words").distinct(), right.select("words").distinct()
    every = sets_l.unionByName(sets_r).select(F.explode("words").alias("token"))
    ranks = every.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    a = _prefixes(sets_l, ranks, least).select("token", F.col("words").alias("a"), F.col("size").alias("n_a"))
    b = _prefixes(sets_r, ranks, least).select("token", F.col("words").alias("b"), F.col("size").alias("n_b"))
    a, b = land(a, "paper_prefixes"), land(b, "record_prefixes")
    near = spread_join(a, b, "token").where(
        (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    )
    share = near.select("a", "b").distinct().withColumn("similarity", similarity(F.col("a"), F.col("b")))
    good = land(share.where(F.col("similarity") >= least), "similar_titles")
    with_left = spread_join(left.withColumnRenamed("words", "a"), good, "a")
    return spread_join(with_left, right.withColumnRenamed("words", "b"), "b").select("paper_id", "record_id", "similarity")


def title_members(rows: DataFrame, key: str) -> DataFrame:
    """(key, class): every row with the words of its title, sorted, as the name of its class; none without a word."""
    return _sets(rows, key).select(key, F.array_join("words", " ").alias("class"))


def title_classes(members: DataFrame, key: str) -> DataFrame:
    """(class, rows, least) of `title_members`: how many rows a class has, and the smallest key, a null one first."""
    return members.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(key)).alias("x")).select(
        "class", "rows", F.col(f"x.{key}").alias("least")
    )


def class_matches(pairs: DataFrame, members: DataFrame, classes: DataFrame, records: DataFrame) -> DataFrame:
    """(paper_id, records, record_id, similarity), one row for each row of `members` (paper_id, class) that matches.

    `pairs` are `match_titles` between classes; `classes` and `records` are the `title_classes`
    of papers and records. `records` counts record rows, `record_id` is the best of them.
    """
    named = records.select(F.col("class").alias("record_id"), F.col("rows").alias("n"), "least")
    each = spread_join(pairs, named, "record_id").select("paper_id", "n", F.col("least").alias("record_id"), "similarity")
    each = land(each, "class_pairs")
    best = each.groupBy("paper_id").agg(F.sum("n").alias("records")).join(best_matches(each), "paper_id")
    found = best.withColumnRenamed("paper_id", "class").join(classes.select("class", "rows"), "class")
    return spread_join(members, found, "class", rows="rows").select("paper_id", "records", "record_id", "similarity")


def best_matches(matches: DataFrame) -> DataFrame:
    """One record per paper: the most similar, of equally similar ones the smallest id."""
    best = matches.groupBy("paper_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "record_id")).alias("x"))
    return best.select("paper_id", F.col("x.record_id").alias("record_id"), (-F.col("x.s")).alias("similarity"))
