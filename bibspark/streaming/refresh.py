"""Indexes kept up to date by Structured Streaming: new papers are added, nothing is rebuilt.

Papers seen before are dropped by the stream's own state, which holds each paper id once, so a
paper that arrives again, in the same batch or after a restart, changes nothing. What a
batch adds to each index (papers by author and year, words by year, collaborations) comes
from the batch operators over the new papers alone and is written as the batch's own
addition. Reading an index adds up the last total and the additions after it.

A batch that is run again after a failure writes the same folders anew. Every
`compact_every` batches the additions are summed into a new total; it counts once its number
is in the list of finished totals, so a total that was not finished is never read.
Additions are sums, so the split of papers into batches does not matter.

The first row to arrive stands for its paper id. Rows without paper id are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators import analytics

PAPERS = "paper_id string, title string, abstract string, authors array<string>, year int, source string"
FILES_PER_BATCH, COMPACT_EVERY = 200, 20


def _collaborations(papers: DataFrame) -> DataFrame:
    listed = analytics.multi_author(papers).select("paper_id", F.explode("authors").alias("author"))
    return analytics.collaborations(listed)


#: Index: (what a set of papers adds to it, its sum column).
INDEXES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "author_stats": (analytics.author_stats, "paper_count"),
    "temporal_topics": (analytics.temporal_topics, "count"),
    "collaborations": (_collaborations, "weight"),
}


def _finished(spark: SparkSession, out: str, name: str) -> int:
    """The number of the last finished total, -1 without one."""
    try:
        done = spark.read.schema("batch bigint").json(f"{out}/{name}/finished")
    except AnalysisException:  # no total yet
        return -1
    last = done.agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def read_index(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The index as of all batches so far."""
    _, amount = INDEXES[name]
    last = _finished(spark, out, name)
    parts = spark.read.parquet(f"{out}/{name}/additions").where(F.col("batch") > last)
    if last >= 0:
        total = spark.read.parquet(f"{out}/{name}/totals").where(F.col("batch") == last)
        parts = parts.unionByName(total)
    keys = [c for c in parts.columns if c not in (amount, "batch")]
    return parts.groupBy(*keys).agg(F.sum(amount).alias(amount))


def read_papers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/papers").drop("batch")


def add_batch(papers: DataFrame, batch: int, out: str, compact_every: int = COMPACT_EVERY) -> None:
    """Writes a batch of new papers and what they add to each index."""
    spark = papers.sparkSession
    papers.write.mode("overwrite").parquet(f"{out}/papers/batch={batch}")
    new = spark.read.schema(papers.schema).parquet(f"{out}/papers/batch={batch}")
    for name, (adds, amount) in INDEXES.items():
        adds(new).write.mode("overwrite").parquet(f"{out}/{name}/additions/batch={batch}")
        if batch - _finished(spark, out, name) >= compact_every:
            read_index(spark, out, name).write.mode("overwrite").parquet(f"{out}/{name}/totals/batch={batch}")
            done = spark.range(1).select(F.lit(batch).cast("bigint").alias("batch"))
            done.coalesce(1).write.mode("append").json(f"{out}/{name}/finished")


def refresh(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: str = PAPERS,
    files_per_batch: int = FILES_PER_BATCH,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """Adds the papers of all landed JSON files not seen before, then stops.

    `prepare` makes papers of a feed's rows, row by row (valid rows, lower case, keys).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    papers = rows if prepare is None else prepare(rows)
    (
        papers.where("paper_id is not null")
        .dropDuplicates(["paper_id"])
        .writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, out, compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
