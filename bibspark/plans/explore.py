"""Questions to the paper index from the command line.

    spark-submit -m bibspark.plans.explore --index DIR search quantum
    … author "Ann Smith" | topic quantum | network "Ann Smith" | year 2023 | rejects
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from bibspark.operators import analytics, clean
from bibspark.session import build_session, delete_landed
from bibspark.sources import tables

QUESTIONS = ["search", "author", "authors", "topic", "network", "year", "top", "rejects", "sources"]


def ask(spark: SparkSession, index: str, question: str, value: str = "") -> DataFrame:
    def table(name: str) -> DataFrame:
        return tables.load_indexes(spark, index, [name])[name]

    if question == "search":
        return clean.present_search(analytics.search_abstract(table("papers"), value))
    if question == "author":
        return analytics.author_activity(table("author_stats"), value)
    if question == "authors":
        return analytics.author_list(table("author_stats"))
    if question == "topic":
        return analytics.keyword_trend(table("temporal_topics"), value)
    if question == "network":
        return analytics.ego_edges(analytics.ego_network(table("collaborations"), value), value)
    if question == "year":
        return analytics.papers_by_year(table("papers"), int(value))
    if question == "top":
        return analytics.top_authors(table("author_stats"))
    if question == "rejects":
        return analytics.inspect_rejects(table("rejected_papers"))
    if question == "sources":
        return analytics.source_counts_sql(table("papers"))
    raise ValueError(f"ask one of {QUESTIONS}, not {question!r}")


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--index", required=True)
    ap.add_argument("question", choices=QUESTIONS)
    ap.add_argument("value", nargs="?", default="")
    args = ap.parse_args()
    spark = build_session("explore")
    ask(spark, args.index, args.question, args.value).show(50, truncate=False)
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
