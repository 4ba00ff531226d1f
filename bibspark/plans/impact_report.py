"""Author impact by name from paper impact and seed metadata.

    spark-submit -m bibspark.plans.impact_report --impact CSV --meta CSV --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators import metrics
from bibspark.session import build_session, delete_landed
from bibspark.sources import tables

IMPACT = "cited_paper_id string, total_semantic_impact double, raw_citation_count bigint"


def report(impact: DataFrame, meta: DataFrame, out: str) -> DataFrame:
    """Write the joined analytics and the author leaderboard; returns the leaderboard."""
    analytics = metrics.join_metadata(impact, meta)
    tables.export_csv(analytics, f"{out}/final_citation_analytics")
    board = metrics.author_impact_by_name(analytics).orderBy(F.desc("total_semantic_impact"), "author")
    tables.export_csv(board, f"{out}/final_author_leaderboard")
    return board


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--impact", required=True)
    ap.add_argument("--meta", required=True)
    ap.add_argument("--out", required=True)
    args = ap.parse_args()
    spark: SparkSession = build_session("impact report")
    # The header names the id and author columns, which differ between metadata files.
    meta = spark.read.options(**tables.CSV_OPTIONS, multiLine="true").csv(args.meta)
    report(tables.read_csv(spark, args.impact, IMPACT), meta, args.out).show(10, truncate=False)
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
