"""Feature and model queries."""

from pyspark.sql import functions as F

from bibspark.catalog.bindings import LAMBDA
from bibspark.catalog.registry import query
from bibspark.operators import features as f
from bibspark.operators import training
from bibspark.session import joined_in_buckets, land


def spread(df, key):
    """(key, position, value), for comparing vectors."""
    return df.select(key, F.posexplode("vector").alias("position", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "embed_text",
    "",
    f"""
SELECT doc_id, {f.EMBED_DIM} AS size,
       CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1 ELSE 0 END::DOUBLE AS norm
FROM documents""",
)
def embed_text(t):
    """Every vector's length and norm: 1, or 0 for a text without words."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return f.embed(t.documents.select("doc_id", "text"), "text").select(
        "doc_id", F.size(v).alias("size"), F.round(norm, 4).alias("norm")
    )


MEAN_SQL = """
SELECT {key}, CAST(position AS INTEGER) AS position, round(avg(value), 6) AS value
FROM (SELECT {group} AS {key}, unnest(vector) AS value, unnest(range(len(vector))) AS position
      FROM {rows}) GROUP BY ALL"""


@query(
    "author_features",
    "writes vectors",
    MEAN_SQL.format(key="author_id", group="author_id", rows="writes JOIN vectors USING (paper_id)"),
)
def author_features(t):
    return spread(f.author_features(t.writes, t.vectors), "author_id")


@query(
    "neighbour_mean",
    "cites vectors",
    MEAN_SQL.format(key="paper_id", group="cited_id", rows="cites JOIN vectors v ON v.paper_id = citing_id"),
)
def neighbour_mean(t):
    return spread(f.neighbour_mean(t.cites, t.vectors), "paper_id")


@query(
    "edge_features",
    "cites vectors",
    """
, sums AS MATERIALIZED (
  SELECT paper_id, list_sum(vector) AS total, vector[1] AS head, len(vector) AS size FROM vectors)
SELECT citing_id, cited_id, CAST(2 * s.size + d.size + 1 AS INTEGER) AS size,
       round(2 * s.total + d.total + delta_t, 6) AS total,
       s.head AS citing_first, d.head AS cited_first, s.head AS edge_first, CAST(delta_t AS DOUBLE) AS delta_t
FROM cites JOIN sums s ON s.paper_id = citing_id JOIN sums d ON d.paper_id = cited_id""",
)
def edge_features(t):
    x = F.col("features")
    return f.edge_features(t.cites, t.vectors).select(
        "citing_id",
        "cited_id",
        F.size(x).alias("size"),
        F.round(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), 6).alias("total"),
        x[0].alias("citing_first"),
        x[64].alias("cited_first"),
        x[128].alias("edge_first"),
        x[192].alias("delta_t"),
    )


ATTENTION = f"""
, scored AS (
  SELECT citing_id, cited_id, list_sum(list_transform(range(1, len(d.vector) + 1),
             lambda i: d.vector[i] * s.vector[i] * s.vector[i]))
         / sqrt(len(d.vector)) * exp(-{LAMBDA} * delta_t) AS score
  FROM cites JOIN vectors s ON s.paper_id = citing_id JOIN vectors d ON d.paper_id = cited_id),
att AS (
  SELECT citing_id, cited_id, score,
         exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS alpha
  FROM scored WINDOW w AS (PARTITION BY cited_id))"""


@query(
    "temporal_attention",
    "cites vectors",
    ATTENTION + " SELECT citing_id, cited_id, round(score, 9) AS score, round(alpha, 6) AS alpha FROM att",
)
def temporal_attention(t):
    att = f.temporal_attention(t.cites, t.vectors, LAMBDA)
    return att.select(
        "citing_id", "cited_id", F.round("score", 9).alias("score"), F.round("alpha", 6).alias("alpha")
    )


@query(
    "attention_sum",
    "cites vectors",
    ATTENTION
    + """
SELECT paper_id, CAST(position AS INTEGER) AS position, round(sum(value), 6) AS value
FROM (SELECT cited_id AS paper_id, alpha * unnest(vector) AS value, unnest(range(len(vector))) AS position
      FROM att JOIN vectors v ON v.paper_id = citing_id) GROUP BY ALL""",
)
def attention_sum(t):
    att = f.temporal_attention(t.cites, t.vectors, LAMBDA)
    return spread(f.attention_sum(att, t.vectors), "paper_id")


@query(
    "class_weights",
    "cites",
    """
, c AS (SELECT intent, 1 / count(*) AS inv FROM cites GROUP BY intent)
SELECT intent, round(inv / (SELECT sum(inv) FROM c) * (SELECT count(*) FROM c), 6) AS weight FROM c""",
)
def class_weights(t):
    return f.class_weights(t.cites, "intent").withColumn("weight", F.round("weight", 6))


SPLIT = f"""(SELECT *, CASE WHEN digit < 8 THEN 'train' WHEN digit = 8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(md5(citing_id || '|' || cited_id || '|{f.SPLIT_SEED}'), 1, 8) AS BIGINT)
               % 10 AS digit FROM cites))"""


@query("edge_split", "cites", f"SELECT citing_id, cited_id, split FROM {SPLIT}")
def edge_split(t):
    return f.edge_split(t.cites).select("citing_id", "cited_id", "split")


# ---- weights and decay learned together ----------------------------------
# Few epochs and a larger step than usual: enough to tell a right gradient from a wrong one.
TRAINING = training.Settings(epochs=4, rate=0.05)


TAUGHT_SQL = f"""taught AS MATERIALIZED (
  SELECT row_number() OVER () AS id, c.*, CASE intent WHEN 'Background' THEN 0 WHEN 'Method' THEN 1 ELSE 2 END AS code,
         CAST(is_key AS INTEGER) AS key_code, delta_t::DOUBLE AS years,
         list_transform(list_zip(a.vector, b.vector), lambda x: x[1] * x[2]) AS f
  FROM {SPLIT} c JOIN vectors a ON a.paper_id = citing_id JOIN vectors b ON b.paper_id = cited_id)"""


def training_views(name: str, code: str, classes: int, size: int = 64) -> str:
    """Views of the same training in SQL: {name}_log, and {name}_p with each edge's class probabilities."""
    s = TRAINING
    parts = [
        f"""{name}_x AS MATERIALIZED (
  SELECT id, unnest(f) AS x, unnest(range({size})) AS i FROM taught WHERE split = 'train')""",
        f"""{name}_0 AS MATERIALIZED (
  SELECT c, i, CASE WHEN c < 0 THEN {s.start_decay} ELSE 0.0 END::DOUBLE AS value, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
  FROM (SELECT unnest(range({classes})) AS c), (SELECT unnest(range({size + 1})) AS i)
  UNION ALL SELECT -1, 0, {s.start_decay}, 0.0, 0.0)""",
    ]

    def scored(epoch: int, where: str) -> str:
        return f"""
  SELECT *, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p,
         row_number() OVER (PARTITION BY id ORDER BY z DESC, c) AS place
  FROM (SELECT id, y, years, c, bare, fading, bare * fading + bias AS z FROM (
    SELECT t.id, t.{code} AS y, t.years, k.c, list_dot_product(t.f, k.w) AS bare, k.bias,
           exp(-abs((SELECT value FROM {name}_{epoch} WHERE c < 0)) * t.years) AS fading
    FROM taught t, (SELECT c, list(value ORDER BY i) FILTER (i < {size}) AS w, sum(value) FILTER (i = {size}) AS bias
                    FROM {name}_{epoch} WHERE c >= 0 GROUP BY c) k
    {where}))
  WINDOW w AS (PARTITION BY id)"""

    for e in range(1, s.epochs + 1):
        parts += [
            f"{name}_s{e} AS MATERIALIZED ({scored(e - 1, "WHERE split = 'train'")})",
            f"""{name}_l{e} AS MATERIALIZED (
  SELECT avg(-ln(p)) AS loss, avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END) AS accuracy, count(*)::DOUBLE AS n
  FROM {name}_s{e} WHERE y = c)""",
            f"""{name}_g{e} AS MATERIALIZED (
  SELECT c, i, g / (SELECT n FROM {name}_l{e}) AS g FROM (
    SELECT c, i, sum((p - CASE WHEN y = c THEN 1 ELSE 0 END) * fading * x) AS g
    FROM {name}_s{e} JOIN {name}_x USING (id) GROUP BY c, i
    UNION ALL SELECT c, {size}, sum(p - CASE WHEN y = c THEN 1 ELSE 0 END) FROM {name}_s{e} GROUP BY c
    UNION ALL SELECT -1, 0, -sign((SELECT value FROM {name}_{e - 1} WHERE c < 0))
                            * sum((p - CASE WHEN y = c THEN 1 ELSE 0 END) * bare * fading * years)
              FROM {name}_s{e}))""",
            f"""{name}_{e} AS MATERIALIZED (
  SELECT c, i, value - {s.rate} * (m / (1 - 0.9 ** {e})) / (sqrt(v / (1 - 0.999 ** {e})) + 1e-8) AS value, m, v FROM (
    SELECT c, i, value, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM (
      SELECT c, i, value, m, v, {s.penalty} * value
             + g * least(1.0, {s.clip} / (sqrt((SELECT sum(g * g) FROM {name}_g{e})) + 1e-6)) AS g
      FROM {name}_{e - 1} JOIN {name}_g{e} USING (c, i))))""",
        ]
    parts.append(
        f"{name}_log AS ("
        + " UNION ALL ".join(
            f"SELECT {e} AS epoch, loss, accuracy, (SELECT abs(value) FROM {name}_{e} WHERE c < 0) AS lam FROM {name}_l{e}"
            for e in range(1, s.epochs + 1)
        )
        + ")"
    )
    parts.append(f"{name}_p AS MATERIALIZED ({scored(s.epochs, '')})")
    return ",\n".join(parts)


INTENT_SQL = f", {TAUGHT_SQL},\n{training_views('intent', 'code', 3)}\n"
KEY_SQL = f", {TAUGHT_SQL},\n{training_views('kc', 'key_code', 2)}\n"
BOTH_SQL = f"{INTENT_SQL}, {training_views('kc', 'key_code', 2)}\n"
LOG_SQL = 'SELECT epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(lam, 6) AS "lambda" FROM {}_log'


def train(t, label, classes):
    taught = t.taught.where("split = 'train'")
    with joined_in_buckets(t.spark):
        return training.fit(taught, label, classes, TRAINING, features=f.FACTORS)


def rounded_log(log):
    return log.select("epoch", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "lambda")])


def predicted(t):
    """Edges with the intent and the importance that the two models give them."""
    return f.predict_jointly(t.taught, train(t, "intent_code", 3)[0], train(t, "key_code", 2)[0], f.FACTORS)


@query("training_epochs", "cites vectors", INTENT_SQL + LOG_SQL.format("intent"))
def training_epochs(t):
    """Loss, accuracy and decay of each epoch in which intent weights and decay are learned together."""
    return rounded_log(train(t, "intent_code", 3)[1])


@query(
    "intent_classifier",
    "cites vectors",
    INTENT_SQL
    + """
SELECT split, intent, count(*) AS edges, count(*) FILTER (p.c = code) AS found
FROM taught JOIN intent_p p USING (id) WHERE place = 1 GROUP BY ALL""",
)
def intent_classifier(t):
    """Edges of each split and true intent, and how many of them the model names rightly."""
    rows = training.predict(t.taught, train(t, "intent_code", 3)[0], f.FACTORS)
    counts = rows.groupBy("split", "intent").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("code") == F.col("intent_code")).alias("found")
    )
    with joined_in_buckets(t.spark):
        return land(counts, "intent_counts")


@query("importance_model", "cites vectors", KEY_SQL + LOG_SQL.format("kc"))
def importance_model(t):
    """The training log of the model of key citations."""
    return rounded_log(train(t, "key_code", 2)[1])


@query(
    "predict_edges",
    "cites vectors",
    BOTH_SQL
    + """
SELECT citing_id, cited_id, ['Background', 'Method', 'Result'][p.c + 1] AS predicted_intent,
       round(k.p, 6) AS raw_importance, taught.years AS delta_t
FROM taught JOIN intent_p p USING (id) JOIN kc_p k USING (id) WHERE p.place = 1 AND k.c = 1""",
)
def predict_edges(t):
    named = predicted(t).select(
        "citing_id",
        "cited_id",
        "predicted_intent",
        F.round("raw_importance", 6).alias("raw_importance"),
        F.col("delta_t").cast("double").alias("delta_t"),
    )
    with joined_in_buckets(t.spark):
        return land(named, "predicted_edges")


@query(
    "accuracy_mae",
    "cites vectors",
    BOTH_SQL
    + """
SELECT split, count(*) AS edges, round(avg(CASE WHEN p.c = code THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(abs(k.p - key_code)), 6) AS mae
FROM taught JOIN intent_p p USING (id) JOIN kc_p k USING (id) WHERE p.place = 1 AND k.c = 1 GROUP BY split""",
)
def accuracy_mae(t):
    report = f.accuracy_mae(predicted(t), "predicted_intent", "intent", "raw_importance", "is_key")
    report = report.select(
        "split", "edges", F.round("accuracy", 6).alias("accuracy"), F.round("mae", 6).alias("mae")
    )
    with joined_in_buckets(t.spark):
        return land(report, "accuracy_mae")


@query(
    "training_log",
    "training_log",
    'SELECT max(epoch) AS epoch, arg_max(lam, epoch) AS "lambda" FROM training_log',
)
def training_log(t):
    return f.last_decay(t.training_log)


@query("project_2d", "vectors", "SELECT paper_id, true AS placed, true AS x_leads FROM vectors")
def project_2d(t):
    """Every paper has finite places, and the first axis spreads at least as far as the second."""
    flat = f.project_2d(t.vectors)
    x, y = F.col("x"), F.col("y")
    leads = flat.agg(F.avg(x * x) - F.avg(x) ** 2 >= F.avg(y * y) - F.avg(y) ** 2).scalar()
    return flat.select("paper_id", (~F.isnan(x + y)).alias("placed"), leads.alias("x_leads"))
