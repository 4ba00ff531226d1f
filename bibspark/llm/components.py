"""Connected components by smallest labels and pointer jumping, one landed table a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.session import land


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): the smallest node it is linked to.

    A round hands each node the smallest label among its neighbours, then replaces a
    label by that label's own label, so that long chains shrink by halves. Each step
    is written and read back: a lost executor costs a step, and both sides of each join
    are plain scans, which adaptive execution can split when a label is shared by many.
    Nothing but the count of changes reaches the driver. No edges, no rows.
    """
    links = land(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links"
    )
    labels = land(
        links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")),
        "labels",
    )
    while True:
        heard = links.join(labels, links.a == labels.node).groupBy(links.b).agg(F.min("label").alias("heard"))
        told = land(
            labels.join(heard, labels.node == heard.b, "left").select(
                "node", F.least("label", "heard").alias("label"), F.col("label").alias("was")
            ),
            "labels",
        )
        if not told.where("label <> was").limit(1).count():
            return told.select("node", "label")
        ahead = told.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = land(
            told.join(ahead, told.label == ahead["at"]).select("node", F.col("next").alias("label")), "labels"
        )
