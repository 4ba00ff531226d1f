"""One person, one key: author ids of several feeds joined where names and papers agree.

Feeds order the words of a name differently and number authors in their own ways. Two ids are
linked if they stand on the same paper under the same name, whatever the order, case and
punctuation of its words; linked ids are one person, also over several papers. Equal names
alone link nothing: namesakes without a common paper stay apart.

Rows of one paper and name form a block. A block links each of its ids to its smallest one, which
joins the same ids as all pairs would, with one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.operators.components import components
from bibspark.session import land
from bibspark.skew import spread_join


def name_key(name: Column) -> Column:
    """The words of a name, lower-cased and sorted; null where it has none."""
    words = F.array_remove(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), "")
    return F.nullif(F.array_join(F.sort_array(words), " "), F.lit(""))


def has_key(name: Column) -> Column:
    """Whether a name has a key, told by its first letter or digit: no words are split for it."""
    return F.lower(name).rlike(r"[\p{L}\p{N}]")


def author_blocks(rows: DataFrame) -> DataFrame:
    """Distinct (paper_id, author_id, name), the name as its key; rows without one of them are dropped."""
    # a test of the key itself would be pushed below the distinct, and the key made again for it
    named = rows.na.drop(subset=["paper_id", "author_id"]).where(has_key(F.col("author_name")))
    return named.select("paper_id", "author_id", name_key(F.col("author_name")).alias("name")).distinct()


def shared_paper_links(rows: DataFrame) -> DataFrame:
    """(a, b) from (paper_id, author_id, author_name): an id and the smallest of its block."""
    keyed = land(author_blocks(rows), "author_blocks")
    block = ["paper_id", "name"]
    least = keyed.groupBy(*block).agg(F.min("author_id").alias("b"), F.count(F.lit(1)).alias("n"))
    linked = spread_join(keyed, least.where("n > 1"), block, rows="n")
    return linked.where("author_id <> b").select(F.col("author_id").alias("a"), "b")


def persons(rows: DataFrame) -> DataFrame:
    """(author_id, person_id) of every id in (paper_id, author_id, author_name).

    A person's key is the smallest of their ids. An id without a usable name, or alone on its
    papers with its name, is a person of its own; rows without an id are dropped.
    """
    ids = rows.select("author_id").where("author_id is not null").distinct()
    found = components(shared_paper_links(rows)).select(
        F.col("node").alias("author_id"), F.col("component").alias("person_id")
    )
    return ids.join(found, "author_id", "left").select("author_id", F.coalesce("person_id", "author_id").alias("person_id"))


def with_persons(writes: DataFrame, people: DataFrame) -> DataFrame:
    """Author rows (author_id, paper_id) by person, each person once a paper.

    Rows whose id `people` does not know keep it.
    """
    named = spread_join(writes.select("author_id", "paper_id"), people, "author_id", "left")
    return named.select(F.coalesce("person_id", "author_id").alias("author_id"), "paper_id").distinct()


def person_report(rows: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, ids, papers, name): a person's ids, papers, and the smallest of their names."""
    named = spread_join(rows, people, "author_id")
    # made distinct before they are counted: no person's papers are gathered by one task
    papers = named.select("person_id", "paper_id").distinct().groupBy("person_id").agg(F.count("paper_id").alias("papers"))
    names = named.groupBy("person_id").agg(F.min("author_name").alias("name"))
    ids = people.groupBy("person_id").agg(F.count(F.lit(1)).alias("ids"))
    return ids.join(papers, "person_id").join(names, "person_id").select("person_id", "ids", "papers", "name")
