"""Add newly landed feed rows to the paper index, its statistics included.

    spark-submit -m bibspark.plans.index_refresh --landing DIR --out DIR --state DIR

Run it again whenever files have landed: each run takes what it has not seen.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from bibspark.operators import clean
from bibspark.session import build_session, delete_landed
from bibspark.streaming import refresh

FEED = "title string, abstract string, authors array<string>, year int, source string"


def feed_papers(rows: DataFrame) -> DataFrame:
    """Valid feed rows in lower case with their key."""
    return clean.final_layout(clean.normalise(clean.valid_papers(rows)))


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--landing", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--state", required=True)
    args = ap.parse_args()
    spark = build_session("index refresh")
    refresh.refresh(spark, args.landing, args.out, args.state, feed_papers, FEED)
    for name in refresh.INDEXES:
        print(name, refresh.read_index(spark, args.out, name).count())
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
