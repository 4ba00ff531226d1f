"""Resumable ingest of landed reply files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bibspark import schemas
from bibspark.sources import payloads

FILES_PER_BATCH = 200


def ingest(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    schema: str,
    flatten: Callable[[DataFrame], DataFrame],
    files_per_batch: int = FILES_PER_BATCH,
) -> None:
    """Flatten all landed JSON files not seen before into Parquet, then stop.

    The checkpoint records which files are done and the sink which batches are
    committed, so a job that dies is simply started again: no file is lost or
    read twice.
    """
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )
    (
        flatten(rows)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def ingest_citations(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """Citation replies (hop1_id, payload) to hop2 edge rows."""
    ingest(spark, landing, out, checkpoint, "hop1_id string, payload string", payloads.flatten_citations)


def read_edges(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(schemas.HOP2_EDGES).parquet(out)


def remaining(ids: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Batch form of resuming: ids not yet processed."""
    return ids.join(processed.select(key).distinct(), key, "left_anti")
