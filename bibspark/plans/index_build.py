"""Build the paper index from two feeds.

    spark-submit -m bibspark.plans.index_build --arxiv FEED --s2 FEED --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators import analytics, clean
from bibspark.session import build_session, delete_landed
from bibspark.sources import feeds, tables


def build_index(spark: SparkSession, arxiv: str, s2: str, out: str) -> dict[str, DataFrame]:
    """Write papers, rejects, author stats, topics and collaborations below `out`.

    Papers are landed first; everything after reads the landed table, so each
    index speaks of the same rows and the feeds are read once for papers and once
    for rejects.
    """
    raw = clean.union_feeds(feeds.scan_arxiv(spark, arxiv), feeds.scan_s2(spark, s2))
    tables.write_plain(clean.rejected_papers(raw), f"{out}/rejected_papers")
    papers = clean.final_layout(clean.dedup_papers(clean.normalise(clean.valid_papers(raw))))
    tables.write_partitioned(papers, f"{out}/papers", sort=["paper_id"])

    landed = tables.load_indexes(spark, out, ["papers"])["papers"]
    tables.write_partitioned(analytics.author_stats(landed), f"{out}/author_stats", sort=["author"])
    tables.write_partitioned(analytics.temporal_topics(landed), f"{out}/temporal_topics", sort=["token"])
    listed = analytics.multi_author(landed).select("paper_id", F.explode("authors").alias("author"))
    tables.write_plain(analytics.collaborations(listed), f"{out}/collaborations")
    return tables.load_indexes(spark, out)


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--arxiv", required=True, nargs="+", help="feed paths; the first that exists is read")
    ap.add_argument("--s2", required=True, nargs="+")
    ap.add_argument("--out", required=True)
    args = ap.parse_args()
    spark = build_session("index build")
    index = build_index(
        spark, feeds.first_existing(spark, *args.arxiv), feeds.first_existing(spark, *args.s2), args.out
    )
    clean.stage_counts(**index).show()
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
