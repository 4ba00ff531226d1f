"""The operators as queries over the given tables, with their SQL where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import (
    centroids,
    decontaminate,
    line_labels,
    mixing,
    neighbours,
    quality,
    repeats,
    runs,
    simhash,
    token_counts,
    token_files,
    toxicity,
    url_filter,
)
from bibspark.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


MIX_WEIGHTS, MIX_SHARE = [3.0, 1.0, 2.0], 1.5


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash_groups")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op2_toxicity_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), labelled)
    return toxicity.score(docs, chain).select(
        "doc_id",
        "held_out",
        F.col("low_quality").alias("low_quality_score"),
        F.col("toxic").alias("score"),
        (F.col("toxic") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_quality_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_separator_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flat-tokens")
    token_counts.write(table(spark, sf_dir, "documents"), path, tokenizer_file())
    counted = token_counts.count(token_counts.read_blocks(spark, path))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return counted.select(number.alias("file"), "ordinal", "start", "n_tokens")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.digest(token_files.read(spark, path))


@query(
    "op6_url_automaton",
    """
    WITH cut AS (
      SELECT page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parts AS (
      SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw_host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
      FROM cut),
    urls AS (
      SELECT page_id, translate(coalesce(raw_host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path
      FROM parts),
    judged AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM urls)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op7_pareto_mix",
    r"""
    WITH docs AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
          / 4503599627370496.0 AS u
      FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    weighed AS (
      SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM sums),
    levels AS (
      SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
        (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (by_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (by_need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
      FROM weighed WINDOW by_need AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
    aims AS (
      SELECT source, source_size, least(2.0::DOUBLE * source_size,
        weight * (SELECT min_by(rate, full_at) FROM levels WHERE rate <= full_at)) AS target FROM levels),
    rated AS (
      SELECT d.*, a.source_size, a.target,
        CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate
      FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
    ranked AS (
      SELECT *, floor(rate)::INT AS certain, rate - floor(rate) AS p,
        CASE WHEN rate - floor(rate) > 0
          THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) ELSE 1e300 END AS odds
      FROM rated),
    summed AS (
      SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS missing,
        sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id) AS up_to FROM ranked),
    firsts AS (SELECT *, p > 0 AND up_to <= missing AS taken_first FROM summed),
    lefts AS (
      SELECT *, missing - coalesce(sum(size) FILTER (taken_first) OVER (PARTITION BY source), 0) AS rest FROM firsts),
    lasts AS (
      SELECT source, arg_min(doc_id, struct_pack(x := abs(rest - size), o := odds, i := doc_id)) AS last_id
      FROM lefts WHERE NOT taken_first AND certain < 2 AND size > 0 AND abs(rest - size) < abs(rest) GROUP BY source)
    SELECT l.doc_id, l.size, l.source_size, l.target,
      (l.size * (l.certain + CASE WHEN l.taken_first OR l.doc_id = s.last_id THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM lefts l LEFT JOIN lasts s ON l.source IS NOT DISTINCT FROM s.source""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    mix = mixing.mix(sizes, MIX_WEIGHTS, MIX_SHARE)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(
    "op8_suffix_buckets",
    """
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
    places AS (SELECT r, doc_id, t, unnest(range(0, greatest(octet_length(t) - 49, 0))) AS p FROM texts),
    strings AS (SELECT r, doc_id, p, array_slice(t, p + 1, p + 50) AS s FROM places),
    firsts AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
    gone AS (
      SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before
      FROM strings JOIN firsts USING (s) WHERE first_id < doc_id),
    numbered AS (
      SELECT r, p, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END)
        OVER (PARTITION BY r ORDER BY p) AS k FROM gone),
    spans AS (SELECT r, min(p) AS b, max(p) + 50 AS e FROM numbered GROUP BY r, k),
    gaps AS (
      SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a, b AS z FROM spans
      UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r),
    kept AS (
      SELECT r, string_agg(hex(array_slice(t, a + 1, coalesce(z, octet_length(t)))), '' ORDER BY a) AS h
      FROM gaps JOIN texts USING (r) GROUP BY r),
    sums AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
    SELECT t.doc_id, octet_length(t.t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
      coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, hex(t.t)))) AS kept_sha256
    FROM texts t LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    lengths = F.transform("spans", lambda s: s["end"] - s["begin"])
    return removed.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op9_one_bit_codes",
    """
    WITH rows AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (
      SELECT r, vec_id, e FROM rows
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    pairs AS (
      SELECT q.r, q.vec_id AS query_id, r.vec_id,
        sqrt(list_sum(list_transform(list_zip(q.e, r.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
      FROM good q JOIN good r ON q.r <> r.r WHERE q.vec_id % 100 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id)::INT AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_string_tiling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_covered", "n_tiles", "coverage")


def _op11_sql() -> str:
    """Five rounds of k-means, one pair of views each."""
    distance = """list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"""
    near = """n{k} AS MATERIALIZED (
      SELECT r, min(struct_pack(distance := {distance}, cluster := cluster)) AS near
      FROM points, c{k} GROUP BY r)"""
    step = """s{k} AS (
      SELECT near.cluster AS cluster, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM n{k} JOIN (SELECT r, unnest(v) AS x, unnest(range(64)) AS i FROM points) USING (r) GROUP BY ALL),
    m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY cluster),
    c{next} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""
    views = []
    for k in range(centroids.ROUNDS):
        views += [near.format(k=k, distance=distance), step.format(k=k, next=k + 1)]
    views.append(near.format(k=centroids.ROUNDS, distance=distance))
    return f"""
    WITH wide AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    points AS MATERIALIZED (
      SELECT r, vec_id, list_transform(e, lambda x: floor(256 * x)::BIGINT) AS v FROM wide
      WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INT AS cluster, v AS c
      FROM points QUALIFY cluster < 40),
    {", ".join(views)},
    sums AS (SELECT near.cluster AS cluster, sum(near.distance)::BIGINT AS inertia FROM n5 GROUP BY 1)
    SELECT vec_id, near.cluster AS cluster, near.distance AS distance, s.inertia AS cluster_inertia,
      (SELECT sum(inertia)::BIGINT FROM sums) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM n5 JOIN points USING (r) JOIN sums s ON s.cluster = near.cluster JOIN c5 ON c5.cluster = near.cluster"""


@query("op11_centroids", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_line_field")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = line_labels.judge(docs, line_labels.fit(docs, table(spark, sf_dir, "labels")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that the contract's documents are made of: every tenth hash ends in a repeated stretch."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


@query(
    "op13_periodic_runs",
    r"""
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id,
        coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS own FROM documents),
    hashed AS (
      SELECT *, len(own) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295::BIGINT, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
          lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) END AS h FROM texts),
    planted AS (
      SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a,
        CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
    docs AS (
      SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
        lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE own END AS words FROM planted),
    places AS (SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i FROM docs),
    equal AS (
      SELECT a.r, b.i - a.i AS q, a.i FROM places a JOIN places b
      ON a.r = b.r AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 2),
    stretches AS (
      SELECT r, q, min(i) AS s, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal)
      GROUP BY r, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
    runs AS (SELECT r, s AS start, length, min(q) AS period FROM stretches GROUP BY r, s, length),
    gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
      SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM places ANTI JOIN gone USING (r, i) GROUP BY r),
    sums AS (
      SELECT r, count(*) AS n_runs, arg_min(
          struct_pack(start := start, length := length, period := period), struct_pack(l := -length, s := start, p := period)) AS top,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t
      FROM runs GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
      1000 * top.length // top.period AS exponent_milli, sha256(coalesce(s.t, '')) AS runs_sha256,
      sha256(coalesce(k.t, '')) AS collapsed_sha256
    FROM docs LEFT JOIN sums s USING (r) LEFT JOIN kept k USING (r)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_order)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    top = F.struct(
        (-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(F.lit(1000) * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
