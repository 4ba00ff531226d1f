"""From raw citation layers to author rankings.

    spark-submit -m bibspark.plans.citation_chain --hops DIR --authors CSV --out DIR
"""

from __future__ import annotations

import argparse
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.operators import clean, features, graph, metrics, training
from bibspark.session import build_session, delete_landed, stamp
from bibspark.sources import tables

DEFAULT_LAMBDA = 0.1


def prepare_graph(
    spark: SparkSession, hop0: DataFrame, hop1: DataFrame, hop2: DataFrame, out: str
) -> tuple[DataFrame, DataFrame]:
    """Land cleaned layers, papers and valid edges with years apart; return papers and edges."""
    order = ["seq"] if all("seq" in h.columns for h in (hop0, hop1, hop2)) else []
    for name, layer in zip(("hop0", "hop1", "hop2"), clean.clean_layers(hop0, hop1, hop2, order)):
        tables.write_plain(layer, f"{out}/{name}")
    h0, h1, h2 = (spark.read.parquet(f"{out}/hop{i}") for i in range(3))
    mid = clean.median_year(h0.select("year"), h1.select("hop1_year"), h2.select("hop2_year")).scalar()
    h0 = clean.impute_missing(h0, "abstract", "title", "year", mid)
    h1 = clean.impute_missing(h1, "hop1_abstract", "hop1_title", "hop1_year", mid)
    h2 = clean.impute_missing(h2, "hop2_abstract", "hop2_title", "hop2_year", mid)
    tables.write_plain(graph.assign_layers(h0, h1, h2, mid), f"{out}/papers")
    tables.write_plain(graph.merge_edges(h1, h2), f"{out}/merged_edges")
    tables.write_plain(graph.export_contexts(h1, h2), f"{out}/citation_contexts")

    papers = spark.read.parquet(f"{out}/papers")
    merged = spark.read.parquet(f"{out}/merged_edges")
    edges = graph.with_years(merged, papers, how="inner")
    edges = graph.encode_intent(edges).select(
        F.col("src").alias("citing_id"),
        F.col("dst").alias("cited_id"),
        "citation_text",
        "intent_code",
        "train_mask",
        *[c for c in ("isKeyCitation",) if c in merged.columns],
        graph.delta_t_scaled(F.col("citing_year"), F.col("cited_year")).alias("delta_t"),
    )
    tables.write_plain(edges, f"{out}/edges")
    return papers, spark.read.parquet(f"{out}/edges")


def predict_intents(
    spark: SparkSession, papers: DataFrame, edges: DataFrame, out: str, dim: int = 64, make_encoder=None
) -> DataFrame:
    """Train on labelled edges, predict all, and land the predictions.

    The importance model learns the key-citation flag; without that flag in the first layer
    there is no importance model and no `raw_importance`.
    """
    texts = papers.select("paper_id", graph.joined_text(F.col("title"), F.col("abstract")).alias("text"))
    vectors = features.embed(texts, "text", make_encoder, dim, "vector").select(
        "paper_id", F.col("vector").cast("array<double>").alias("vector")
    )
    tables.write_plain(vectors, f"{out}/vectors")
    contexts = features.embed(edges, "citation_text", make_encoder, dim, "context_vector").withColumn(
        "context_vector", F.col("context_vector").cast("array<double>")
    )
    featured = features.edge_features(contexts, spark.read.parquet(f"{out}/vectors"), "context_vector")
    tables.write_plain(featured.drop("context_vector"), f"{out}/edge_features")
    featured = spark.read.parquet(f"{out}/edge_features")
    labelled = featured.where("train_mask")
    importance = None
    if "isKeyCitation" in labelled.columns:
        importance = features.fit_importance(labelled.where("isKeyCitation is not null"), "isKeyCitation")
    predicted = features.predict_edges(featured, features.fit_intent(labelled), importance)
    tables.write_plain(predicted, f"{out}/edge_predictions")
    return spark.read.parquet(f"{out}/edge_predictions")


def learn_decay(spark: SparkSession, out: str, epochs: int) -> DataFrame:
    """Learn intent weights and decay together from the landed edge features; lands and returns the training log.

    Each epoch is kept below `out`, so that a training that was stopped goes on after the last
    one. What was kept holds for the very files of features it was learned from.
    """
    own = hashlib.md5(stamp(spark, f"{out}/edge_features").encode()).hexdigest()
    taught = spark.read.parquet(f"{out}/edge_features").where("train_mask")
    _, log = training.fit(
        taught, "intent_code", len(features.INTENT_NAMES), training.Settings(epochs=epochs),
        state=f"{out}/training_state/{own}",
    )
    tables.export_csv(log, f"{out}/training_log")
    return tables.read_csv(spark, f"{out}/training_log", schemas.TRAINING_LOG)


def rank_authors(
    predictions: DataFrame, writes: DataFrame, out: str, lam: Column | float = DEFAULT_LAMBDA
) -> DataFrame:
    """Land weighted edges, then the author ranking as CSV; returns the ranking."""
    edges = predictions.withColumn("intent", F.col("predicted_intent"))
    tables.write_plain(metrics.weigh_edges(edges, lam), f"{out}/weighted_edges")
    spark = predictions.sparkSession
    weighted = spark.read.parquet(f"{out}/weighted_edges")
    ranking = metrics.hp_frac(weighted, writes).orderBy(F.desc("semantic_hp_frac"), "author_id")
    tables.export_csv(ranking, f"{out}/author_rankings")
    return tables.read_csv(
        spark,
        f"{out}/author_rankings",
        "author_id string, normal_hp_frac double, semantic_hp_frac double, total_papers bigint, "
        "impact_shift double",
    )


def run(
    spark: SparkSession,
    hops: str,
    authors: str,
    out: str,
    lam: float = DEFAULT_LAMBDA,
    make_encoder=None,
    log: str | None = None,
    multi_line: bool = True,
    epochs: int = 0,
) -> DataFrame:
    """The whole chain. `log` is a training log (CSV); its last λ then weighs the edges, not `lam`.

    With `epochs` the log is learned here, from the edges with a known intent.
    """
    papers, edges = prepare_graph(spark, *tables.scan_hops(spark, hops, multi_line), out)
    predictions = predict_intents(spark, papers, edges, out, make_encoder=make_encoder)
    writes = tables.read_csv(spark, authors, schemas.PAPER_AUTHORS).select("author_id", "paper_id")
    if epochs:
        learned = learn_decay(spark, out, epochs)
        lam = features.last_decay(learned).select("lambda").scalar()
    elif log is not None:
        lam = features.last_decay(tables.read_csv(spark, log, schemas.TRAINING_LOG)).select("lambda").scalar()
    return rank_authors(predictions, writes, out, lam)


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--hops", required=True)
    ap.add_argument("--authors", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--lam", type=float, default=DEFAULT_LAMBDA)
    ap.add_argument("--log", help="training log whose last decay is used instead of --lam")
    ap.add_argument("--epochs", type=int, default=0, help="learn the decay in so many epochs")
    ap.add_argument("--split-files", action="store_true", help="no field holds a line break")
    args = ap.parse_args()
    spark = build_session("citation chain")
    metrics.leaderboard(
        run(
            spark, args.hops, args.authors, args.out, args.lam, log=args.log,
            multi_line=not args.split_files, epochs=args.epochs,
        ),
        "semantic_hp_frac",
        "author_id",
    ).show(truncate=False)
    delete_landed(spark)
    spark.stop()


if __name__ == "__main__":
    main()
