"""Paper feeds: JSON lines, Atom XML and search replies, and the query ledger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.functions import text as tx

DEFAULT_YEAR = 2023


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists: a live feed before its sample."""
    for path in paths:
        try:
            spark.read.text(path)
            return path
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def scan_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """(title, abstract, authors, year, source) of an arXiv-style feed."""
    return spark.read.schema(schemas.ARXIV_FEED).json(path).select(
        "title",
        "abstract",
        tx.join_name_lists(F.col("authors_parsed")).alias("authors"),
        tx.year_from_date(F.col("update_date")).alias("year"),
        F.lit("arxiv").alias("source"),
    )


def scan_s2(spark: SparkSession, path: str) -> DataFrame:
    """The same layout of an S2-style feed."""
    return spark.read.schema(schemas.S2_FEED).json(path).select(
        "title",
        "abstract",
        tx.join_name_structs(F.col("authors")).alias("authors"),
        "year",
        F.lit("s2orc").alias("source"),
    )


def _one_line(text):
    return F.regexp_replace(text, "\n", " ")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as arXiv feed rows; those without title or date are skipped."""
    entries = (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .option("ignoreNamespace", "true")
        .schema(schemas.ATOM_ENTRY)
        .load(path)
    )
    names = F.filter(
        F.transform(F.coalesce("author", F.array()), lambda x: x["name"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    return entries.where("title is not null and published is not null").select(
        F.coalesce("id", F.lit("")).alias("id"),
        _one_line(F.col("title")).alias("title"),
        _one_line(F.when(F.col("summary") != "", F.col("summary"))).alias("abstract"),
        F.substring("published", 1, 10).alias("update_date"),
        F.transform(names, tx.split_name_list).alias("authors_parsed"),
    )


def search_hits(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits of search replies as S2 feed rows; a missing or zero year becomes 2023."""
    hits = replies.select(
        F.explode(F.from_json(payload, schemas.SEARCH_PAYLOAD)["data"]).alias("hit")
    ).select("hit.*")
    names = F.filter(
        F.transform(F.coalesce("authors", F.array()), lambda x: x["name"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    return hits.select(
        F.coalesce("paperId", F.lit("")).alias("paper_id"),
        "title",
        "abstract",
        F.when(F.coalesce("year", F.lit(0)) == 0, DEFAULT_YEAR).otherwise(F.col("year")).alias("year"),
        F.transform(names, tx.split_name_struct).alias("authors"),
    )


def pending_queries(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requested queries not in the ledger, whatever their case."""
    done = ledger.select(F.lower("query").alias("_key")).distinct()
    return (
        requested.withColumn("_key", F.lower("query")).join(done, "_key", "left_anti").drop("_key")
    )


def ledger_entries(succeeded: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger rows for queries that were answered; failed ones stay pending."""
    return pending_queries(
        succeeded.select(F.lower("query").alias("query")).distinct(), ledger
    )


def landing_append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
