"""Substring search over paper abstracts by an index of posting lists.

Every three letters in a row of an abstract are a gram; an abstract of fewer letters is one gram
itself. The index has, for each gram and block of papers, the places in the block of the papers that
hold it, sorted and stored as differences (Parquet's delta encoding), in files sorted by gram, so
that a lookup skips all others; a directory
of grams with their paper counts; and the papers in folders by block. A search looks its
needle's grams up in the directory, intersects the postings of the rarest few, opens the blocks of
the candidates only, and keeps the papers that really contain the needle. It reads less the
rarer the needle is.

A list of a gram holds at most a block's papers, so no list is gathered beyond that. Papers
without abstract are never found; the empty needle finds all others, as a scan would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators.graph import dense_index
from bibspark.session import land
from bibspark.skew import spread_join
from bibspark.sources import tables

GRAM = 3
#: Papers of a block; grams of a needle that are intersected; blocks that are named to the scan, more are joined.
BLOCK_PAPERS, RAREST, MOST_NAMED = 1 << 16, 4, 1000
#: Parquet's delta encoding for the places.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}


def grams(letters: Column) -> Column:
    """The distinct grams of an array of letters."""
    n = F.size(letters)
    whole = F.array_join(letters, "")
    three = F.transform(
        F.slice(letters, 1, F.greatest(n - (GRAM - 1), F.lit(1))),
        lambda x, i: F.concat(x, *[F.get(letters, i + k) for k in range(1, GRAM)]),
    )
    return F.when(n == 0, F.array().cast("array<string>")).when(n < GRAM, F.array(whole)).otherwise(F.array_distinct(three))


def build(papers: DataFrame, path: str, block_papers: int = BLOCK_PAPERS) -> None:
    """Writes papers (one row per paper_id), postings and directory below `path`."""
    numbers = dense_index(papers.select("paper_id"))
    numbered = spread_join(papers, numbers, "paper_id").withColumn("block", F.floor(F.col("idx") / block_papers))
    tables.write_partitioned(numbered.withColumnRenamed("idx", "number"), f"{path}/papers", "block", ["number"])
    held = papers.sparkSession.read.parquet(f"{path}/papers").where(F.col("abstract").isNotNull())
    place = (F.col("number") - F.col("block") * block_papers).cast("int").alias("place")
    letters = held.select("block", place, F.filter(F.split("abstract", ""), lambda x: x != "").alias("letters"))
    each = letters.select("block", "place", F.explode(grams(F.col("letters"))).alias("gram"))
    lists = each.groupBy("gram", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    (
        lists.repartitionByRange("gram", "block")
        .sortWithinPartitions("gram", "block")
        .write.mode("overwrite")
        .options(**DELTAS)
        .parquet(f"{path}/postings")
    )
    postings = papers.sparkSession.read.parquet(f"{path}/postings")
    counts = postings.groupBy("gram").agg(F.sum(F.size("places")).alias("papers"))
    tables.write_plain(counts.repartitionByRange("gram").sortWithinPartitions("gram"), f"{path}/grams")
    tables.write_plain(papers.sparkSession.range(1).select(F.lit(block_papers).alias("block_papers")), f"{path}/settings")


def places(postings: DataFrame) -> DataFrame:
    """(gram, block, place): the papers of posting lists, by place in their block."""
    return postings.select("gram", "block", F.explode("places").alias("place"))


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(block, place) of all papers that may hold the needle, from the posting lists alone."""
    directory, postings = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/postings")
    if len(needle) < GRAM:
        # grams that hold the needle; the directory has each gram once
        fitting = directory.where(F.contains("gram", F.lit(needle))).select("gram")
        return places(postings.join(fitting, "gram", "left_semi")).select("block", "place").distinct()
    wanted = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    known = directory.where(F.col("gram").isin(wanted)).orderBy("papers", "gram").collect()  # a row a gram of the needle
    if len(known) < len(wanted):
        return postings.where(F.lit(False)).select("block", F.lit(0).alias("place"))
    rarest = [r.gram for r in known[:RAREST]]
    found = places(postings.where(F.col("gram").isin(rarest)))
    return found.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).drop("n")


def search(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """The papers whose abstract contains the keyword in lower case."""
    needle = keyword.lower()
    papers = spark.read.parquet(f"{path}/papers")
    if not needle:
        return papers.where(F.col("abstract").isNotNull()).drop("block", "number")
    block_papers = spark.read.parquet(f"{path}/settings").first().block_papers
    found = land(candidates(spark, path, needle), "candidates")
    blocks = [r.block for r in found.select("block").distinct().limit(MOST_NAMED + 1).collect()]
    if len(blocks) <= MOST_NAMED:
        papers = papers.where(F.col("block").isin(blocks))
    place = (F.col("number") - F.col("block") * block_papers).cast("int")
    near = papers.withColumn("place", place).join(found, ["block", "place"], "left_semi")
    return near.where(F.contains("abstract", F.lit(needle))).drop("block", "number", "place")
