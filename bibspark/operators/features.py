"""Vectors, attention weights and intent models in Spark ML form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from bibspark.functions import text as tx
from bibspark.operators.metrics import decay
from bibspark.operators.training import DecayModel, predict_all
from bibspark.session import delete_landed, joined_in_buckets, land, land_bucketed
from bibspark.skew import find_hot, spread_join

# Name of each intent code.
INTENT_NAMES = ["Background", "Method", "Result"]
EMBED_DIM = 768
ENCODER_BATCH = 16
SPLIT_SEED = 42
# Bytes of vectors that a cell of papers stands for; a task holds those of one cell.
CELL_BYTES = 64 << 20
# The vectors of an edge's ends: multiplied by place they are its `features`.
FACTORS = ["citing_vector", "cited_vector"]


def embed(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
    dim: int = EMBED_DIM,
    out: str = "embedding",
) -> DataFrame:
    """Adds a vector per text.

    `make_encoder` builds the encoder once per Python worker; it then sees the
    texts in small batches. Without one, words are hashed into `dim` buckets and
    the counts scaled to unit length, all in the JVM.
    """
    if make_encoder is None:
        words = df.withColumn("_words", tx.tokens(F.coalesce(F.col(text_col), F.lit(""))))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            values = texts.fillna("").tolist()
            vectors: list = []
            for i in range(0, len(values), ENCODER_BATCH):
                vectors.extend(np.asarray(encode(values[i : i + ENCODER_BATCH]), dtype=np.float32))
            yield pd.Series(vectors)

    encode_batches.__annotations__ = {
        "batches": Iterator[pd.Series], "return": Iterator[pd.Series]
    }
    run = F.pandas_udf(encode_batches, ArrayType(FloatType()))
    return df.withColumn(out, run(F.col(text_col)))


def mean_vectors(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, vector): the mean of a key's vectors, combined on the map side."""
    mean = Summarizer.mean(array_to_vector(_wide(vector)))
    return rows.groupBy(key).agg(mean.alias("_mean")).select(
        key, vector_to_array("_mean").alias("vector")
    )


def author_features(writes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of the papers an author wrote."""
    rows = spread_join(writes.select("author_id", "paper_id"), vectors, "paper_id")
    return mean_vectors(rows, "author_id")


def neighbour_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of the papers citing each cited paper."""
    edges = edges.select("citing_id", "cited_id")
    hot = find_hot(edges, "citing_id", "cited_id")
    if not _any_hot(hot):
        return _sums_in_cells(edges, vectors, mean=True)
    citing = vectors.select(F.col("paper_id").alias("citing_id"), "vector")
    rows = spread_join(edges, citing, "citing_id", hot=hot)
    return mean_vectors(rows, "cited_id").withColumnRenamed("cited_id", "paper_id")


def _any_hot(hot: dict[str, DataFrame | None]) -> bool:
    return any(rows is not None for rows in hot.values())


def _with_end_vectors(
    edges: DataFrame, vectors: DataFrame, hot: dict[str, DataFrame | None] | None = None
) -> DataFrame:
    out, hot = edges, hot or find_hot(edges, "citing_id", "cited_id")
    for end in ("citing", "cited"):
        named = vectors.select(F.col("paper_id").alias(f"{end}_id"), F.col("vector").alias(f"{end}_vector"))
        out = spread_join(out, named, f"{end}_id", hot=hot)
    return out


def _cells(vectors: DataFrame) -> int:
    """Cells that papers are dealt to: enough that one's vectors fit a task."""
    width = 8 if dict(vectors.dtypes)["vector"] == "array<double>" else 4
    numbers = vectors.agg(F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0))), F.lit(0)).alias("n")).first().n
    return max(vectors.sparkSession.sparkContext.defaultParallelism, -(-numbers * width // CELL_BYTES))


def _cell(paper: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(paper), F.lit(cells)).cast("int").alias("_cell")


def _dealt(edges: DataFrame, vectors: DataFrame, cells: int) -> DataFrame:
    """(_cell, citing_id, citing_vector, _ends): a citing paper's vector once a cell of papers it cites, with its edges to them.

    So a vector moves as often as there are cells at most, not once an edge. No key may be hot.
    """
    whole = edges.where("citing_id is not null and cited_id is not null").repartition("citing_id")
    rest = F.struct(*[c for c in edges.columns if c != "citing_id"])
    ends = whole.groupBy("citing_id", _cell("cited_id", cells)).agg(F.collect_list(rest).alias("_ends"))
    named = vectors.select(F.col("paper_id").alias("citing_id"), F.col("vector").alias("citing_vector"))
    return ends.join(named, "citing_id").select("_cell", "citing_id", "citing_vector", "_ends")


def _in_cells(edges: DataFrame, vectors: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """`_with_end_vectors` without hot keys, with `_cell`, from landed tables; their cells and paths.

    Both sides lie in buckets by cell: a query that runs in `joined_in_buckets` joins a cell's vectors
    to its edges within a task, and moves neither.
    """
    cells = _cells(vectors)
    dealt, dealt_path = land_bucketed(_dealt(edges, vectors, cells), "edge_cells", "_cell", cells)
    named = vectors.where("paper_id is not null").select(
        _cell("paper_id", cells), F.col("paper_id").alias("cited_id"), F.col("vector").alias("cited_vector")
    )
    cited, cited_path = land_bucketed(named, "vector_cells", "_cell", cells)
    rows = dealt.select("_cell", "citing_id", "citing_vector", F.inline("_ends"))
    rest = [c for c in edges.columns if c not in ("citing_id", "cited_id")]
    joined = rows.join(cited.hint("shuffle_hash"), ["_cell", "cited_id"])
    return joined.select("_cell", "cited_id", "citing_id", *rest, *FACTORS), cells, [dealt_path, cited_path]


def _sums_in_cells(edges: DataFrame, vectors: DataFrame, weight: str | None = None, mean: bool = False) -> DataFrame:
    """(paper_id, vector): the sum or mean of the citing papers' vectors, each times its edge's `weight`.

    A citing vector moves once a cell of cited papers. The sums of a cell's papers are added in the task that
    holds it, number by number, in a hash table of plain columns. No key may be hot.
    """
    cells = _cells(vectors)
    longest = vectors.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    rows = _dealt(edges, vectors, cells).repartition(cells, "_cell")
    rows = rows.select("_cell", _wide("citing_vector").alias("_v"), F.inline("_ends"))
    times = F.lit(1.0) if weight is None else F.col(weight)
    sums = [F.sum(F.get("_v", F.lit(i)) * times).alias(f"_{i}") for i in range(longest)]
    counts = [F.count("_v").alias("_rows"), F.min(F.size("_v")).alias("_size"), F.max(F.size("_v")).alias("_most")]
    found = rows.where("_v is not null").groupBy("_cell", "cited_id").agg(*counts, *sums)
    by = F.col("_rows") if mean else F.lit(1)
    total = F.slice(F.array(*[F.col(f"_{i}") / by for i in range(longest)]).cast("array<double>"), F.lit(1), F.col("_size"))
    uneven = F.raise_error(F.lit("vectors of different lengths are summed")).cast("array<double>")
    return found.select(
        F.col("cited_id").alias("paper_id"), F.when(F.col("_size") == F.col("_most"), total).otherwise(uneven).alias("vector")
    )


def edge_features(edges: DataFrame, vectors: DataFrame, edge_vector: str | None = None) -> DataFrame:
    """Adds `features`: citing, cited and edge vector, then the years apart.

    Without an edge vector of its own an edge takes that of the citing paper,
    whose text holds the citing sentence. Edges with an end that has no vector
    have no features and are left out.
    """
    joined = _with_end_vectors(edges, vectors)
    edge = _wide(edge_vector or "citing_vector")
    features = F.concat(
        _wide("citing_vector"), _wide("cited_vector"), edge, F.array(F.col("delta_t").cast("double"))
    )
    return joined.withColumn("features", features).drop("citing_vector", "cited_vector")


def interactions(
    edges: DataFrame, vectors: DataFrame, edge_vector: str | None = None, multiplied: bool = True
) -> DataFrame:
    """Adds `features`: the terms whose sum is the attention of an edge, citing times cited times edge vector.

    Without an edge vector of its own an edge has the products of its ends. Edges with an
    end that has no vector are left out. Not `multiplied`, an edge without a vector of its own has the `FACTORS`
    of its features instead; they are landed, each vector once a paper and cell, to be read many times by
    queries that run in `joined_in_buckets`.
    """
    if not multiplied and edge_vector is None:
        hot = find_hot(edges, "citing_id", "cited_id")
        if _any_hot(hot):
            return land(_with_end_vectors(edges, vectors, hot), "end_vectors")
        return _in_cells(edges, vectors)[0].drop("_cell")
    joined = _with_end_vectors(edges, vectors)
    terms = _times(_wide("citing_vector"), _wide("cited_vector"))
    if edge_vector is not None:
        terms = _times(terms, _wide(edge_vector))
    return joined.withColumn("features", terms).drop("citing_vector", "cited_vector")


def _wide(vector: str) -> Column:
    """Vectors travel through joins as they are stored, and are widened where they are used."""
    return F.col(vector).cast("array<double>")


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def softmax_by(df: DataFrame, group: str, score: str, out: str, cell: str | None = None) -> DataFrame:
    """Softmax of `score` within each group, shifted by the group's greatest score.

    Two map-side combined aggregations and a join back; no group is gathered in
    one task. Scores and per-group sums are landed, as each is read repeatedly.
    Of a landed table in buckets by `cell`, with whole groups that fit a task, both are
    taken where the rows lie.
    """
    if cell is not None:
        rows = Window.partitionBy(cell, group)
        return (
            df.withColumn("_max", F.max(score).over(rows))
            .withColumn("_exp", F.exp(F.col(score) - F.col("_max")))
            .withColumn(out, F.col("_exp") / F.sum("_exp").over(rows))
            .drop("_max", "_exp", cell)
        )
    scored = land(df, "softmax_scores")
    peak = scored.groupBy(group).agg(F.max(score).alias("_max"), F.count(F.lit(1)).alias("_rows"))
    shifted = spread_join(scored.select(group, score), peak, group, rows="_rows")
    stats = shifted.groupBy(group).agg(
        F.max("_max").alias("_max"),
        F.sum(F.exp(F.col(score) - F.col("_max"))).alias("_sum"),
        F.count(F.lit(1)).alias("_rows"),
    )
    stats = land(stats, "softmax_sums")
    return (
        spread_join(scored, stats, group, rows="_rows")
        .withColumn(out, F.exp(F.col(score) - F.col("_max")) / F.col("_sum"))
        .drop("_max", "_sum", "_rows")
    )


def temporal_attention(
    edges: DataFrame, vectors: DataFrame, lam: float, edge_vector: str | None = None
) -> DataFrame:
    """(citing_id, cited_id, score, alpha): decayed attention, normalised per cited paper.

    The score is the sum of query · key · edge over the vector, divided by the
    root of its length; the cited paper asks, the citing paper answers. `edge_vector`
    names the edges' own vector, that of the citing sentence; without one an edge
    takes that of the citing paper, whose text holds the sentence. Edges with an end
    that has no vector have no score and are left out.
    """
    own = [edge_vector] if edge_vector else []
    edges = edges.select("citing_id", "cited_id", "delta_t", *own)
    hot = find_hot(edges, "citing_id", "cited_id")
    edge = F.col(edge_vector) if edge_vector else F.col("citing_vector")
    triple = _times(_times(_wide("cited_vector"), _wide("citing_vector")), edge.cast("array<double>"))
    score = _total(triple) / F.sqrt(F.size("cited_vector")) * decay(lam, F.col("delta_t"))
    if edge_vector is None and not _any_hot(hot):
        joined, cells, paths = _in_cells(edges, vectors)
        spark = edges.sparkSession
        with joined_in_buckets(spark):
            scored = joined.select("_cell", "citing_id", "cited_id", score.alias("score"))
            scored, _ = land_bucketed(scored, "softmax_scores", "_cell", cells)
        delete_landed(spark, paths)
        return softmax_by(scored, "cited_id", "score", "alpha", cell="_cell")
    joined = _with_end_vectors(edges, vectors, hot)
    scored = joined.select("citing_id", "cited_id", score.alias("score"))
    return softmax_by(scored, "cited_id", "score", "alpha")


def attention_sum(attention: DataFrame, vectors: DataFrame) -> DataFrame:
    """(paper_id, vector): the attention-weighted sum of the citing papers' vectors."""
    hot = find_hot(attention, "citing_id", "cited_id")
    if not _any_hot(hot):
        return _sums_in_cells(attention.select("citing_id", "cited_id", "alpha"), vectors, "alpha")
    citing = vectors.select(F.col("paper_id").alias("citing_id"), "vector")
    rows = spread_join(attention, citing, "citing_id", hot=hot)
    # The summarizer weighs each vector, so the sum is the weighted one.
    total = Summarizer.metrics("sum").summary(array_to_vector(_wide("vector")), F.col("alpha"))
    return (
        rows.groupBy("cited_id")
        .agg(total.alias("_s"))
        .select(F.col("cited_id").alias("paper_id"), vector_to_array("_s.sum").alias("vector"))
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight): inverse frequencies scaled to sum to the number of classes."""
    counts = rows.groupBy(label).agg((1 / F.count(F.lit(1))).alias("_inv"))
    scale = counts.agg(F.count(F.lit(1)) / F.sum("_inv"))
    return counts.select(label, (F.col("_inv") * scale.scalar()).alias("weight"))


def edge_split(edges: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds `split`: train / val / test in the ratio 80 / 10 / 10, fixed per edge and seed."""
    text = F.concat_ws("|", "citing_id", "cited_id", F.lit(str(seed)))
    digit = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10
    return edges.withColumn(
        "split", F.when(digit < 8, "train").when(digit == 8, "val").otherwise("test")
    )


def _vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col("features")))


def fit_intent(train: DataFrame, label: str = "intent_code", iterations: int = 20):
    """Multinomial intent model on balanced weights."""
    weights = class_weights(train, label)
    # One row per class.
    weighted = train.join(F.broadcast(weights), label)
    model = LogisticRegression(
        featuresCol="_features", labelCol=label, weightCol="weight", family="multinomial",
        maxIter=iterations, regParam=1e-4, predictionCol="intent_prediction",
        probabilityCol="intent_probability", rawPredictionCol="intent_raw",
    )
    return model.fit(_vector(weighted).select("_features", label, "weight"))


def fit_importance(train: DataFrame, label: str = "is_key", iterations: int = 20):
    """Binary model of the key-citation flag."""
    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", family="binomial", maxIter=iterations,
        regParam=1e-4, predictionCol="importance_prediction",
        probabilityCol="importance_probability", rawPredictionCol="importance_raw",
    )
    flagged = train.withColumn("_label", F.coalesce(F.col(label), F.lit(False)).cast("double"))
    return model.fit(_vector(flagged).select("_features", "_label"))


def predict_edges(edges: DataFrame, intent_model, importance_model=None) -> DataFrame:
    """Edges with predicted intent, and with an importance if there is a model of it."""
    scored = intent_model.transform(_vector(edges))
    importance = []
    if importance_model is not None:
        scored = importance_model.transform(scored)
        importance = [vector_to_array("importance_probability")[1].alias("raw_importance")]
    names = F.array(*[F.lit(n) for n in INTENT_NAMES])
    return scored.select(
        *[c for c in edges.columns if c != "features"],
        F.coalesce(F.get(names, F.col("intent_prediction").cast("int")), F.lit("Unknown")).alias(
            "predicted_intent"
        ),
        F.col("intent_prediction").cast("int").alias("predicted_code"),
        *importance,
    )


def predict_jointly(
    edges: DataFrame,
    intent: DecayModel,
    importance: DecayModel | None = None,
    features: str | Sequence[str] = "features",
) -> DataFrame:
    """`predict_edges` by models whose weights and decay were learned together."""
    models = {"predicted": intent} | ({"importance": importance} if importance is not None else {})
    scored = predict_all(edges, models, features).drop("predicted_probability")
    if importance is not None:
        scored = scored.withColumn("raw_importance", F.col("importance_probability")[1])
        scored = scored.drop("importance_code", "importance_probability")
    names = F.array(*[F.lit(n) for n in INTENT_NAMES])
    named = F.coalesce(F.get(names, F.col("predicted_code")), F.lit("Unknown"))
    return scored.withColumn("predicted_intent", named)


def accuracy_mae(
    predictions: DataFrame, predicted: str, actual: str, importance: str, flag: str, by: str = "split"
) -> DataFrame:
    """Accuracy of the intent and mean absolute error of the importance, per split."""
    return predictions.groupBy(by).agg(
        F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"),
        F.avg(F.abs(F.col(importance) - F.col(flag).cast("double"))).alias("mae"),
        F.count(F.lit(1)).alias("edges"),
    )


def objective_history(spark, model) -> DataFrame:
    """(epoch, loss) of a fitted model: one row per iteration."""
    rows = [(i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "epoch int, loss double")


def last_decay(log: DataFrame) -> DataFrame:
    """(epoch, lambda) of the last epoch of a training log."""
    return log.agg(F.max("epoch").alias("epoch"), F.max_by("lambda", "epoch").alias("lambda"))


def project_2d(vectors: DataFrame) -> DataFrame:
    """(…, x, y): the two leading principal components."""
    data = vectors.withColumn("_v", array_to_vector(F.col("vector")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(data)
    flat = model.transform(data).withColumn("_p", vector_to_array("_p"))
    return flat.select(
        *[c for c in vectors.columns if c != "vector"], F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y")
    )
