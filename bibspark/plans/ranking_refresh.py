"""Add newly landed citations to the author ranking, reading only what they reach.

    spark-submit -m bibspark.plans.ranking_refresh --landing DIR --state DIR --checkpoint DIR [--writes DIR]

`--writes` (Parquet: author_id, paper_id) starts a new state; later runs leave it out. Landed JSON lines
hold citing_id, cited_id and semantic_weight.
"""

from __future__ import annotations

import argparse

from bibspark.session import build_session, delete_landed
from bibspark.streaming import ranking


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--landing", required=True)
    ap.add_argument("--state", required=True)
    ap.add_argument("--checkpoint", required=True)
    ap.add_argument("--writes")
    args = ap.parse_args()
    spark = build_session("ranking refresh")
    if args.writes:
        ranking.start(spark.read.parquet(args.writes), args.state)
    ranking.follow(spark, args.landing, args.state, args.checkpoint)
    best = ranking.ranking(spark, args.state)
    best.orderBy(best.semantic_hp_frac.desc(), "author_id").show(20, truncate=False)
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
