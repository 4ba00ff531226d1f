"""Bibliometric queries."""

from pyspark.sql import functions as F

from bibspark.catalog.registry import query
from bibspark.operators import metrics as m
from bibspark.session import new_path
from bibspark.streaming import ranking

HIRSCH = "CAST(sum(CASE WHEN round({v}, 9) >= {r} THEN 1 ELSE 0 END) AS DOUBLE)"


def h_sql(v: str, r: str) -> str:
    return HIRSCH.format(v=v, r=r)


def rank_sql(group: str, v: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {v} DESC)"


def credit_sql(weights: dict[str, float], default: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in weights.items())
    return f"CASE intent {cases} ELSE {default} END"


@query(
    "intent_multiplier",
    "cites",
    f"""
SELECT intent, {credit_sql(m.SCALED)} AS scaled, {credit_sql(m.EVALUATION)} AS evaluation,
       {credit_sql(m.BASELINE)} AS baseline, count(*) AS edges
FROM cites GROUP BY intent""",
)
def intent_multiplier(t):
    i = F.col("intent")
    return t.cites.groupBy("intent").agg(F.count(F.lit(1)).alias("edges")).select(
        "intent",
        m.intent_multiplier(i, m.SCALED).alias("scaled"),
        m.intent_multiplier(i, m.EVALUATION).alias("evaluation"),
        m.intent_multiplier(i, m.BASELINE).alias("baseline"),
        "edges",
    )


@query(
    "decay_weight",
    "weighted",
    """
SELECT citing_id, cited_id, intent, CAST(delta_t AS INTEGER) AS delta_t,
       round(CAST(semantic_weight AS DOUBLE), 9) AS semantic_weight
FROM weighted""",
)
def decay_weight(t):
    return t.weighted.select(
        "citing_id", "cited_id", "intent", "delta_t", F.round("semantic_weight", 9).alias("semantic_weight")
    )


@query(
    "paper_scores",
    "cited_scores nodes",
    """
SELECT n.paper_id, round(coalesce(CAST(s_c AS DOUBLE), 0), 6) AS s_c, coalesce(raw, 0) AS raw
FROM nodes n LEFT JOIN cited_scores USING (paper_id)""",
)
def paper_scores(t):
    return m.paper_scores(t.nodes, t.weighted).withColumn("s_c", F.round("s_c", 6))


@query(
    "baseline_ranking",
    "cites",
    f"""
SELECT cited_id AS paper_id, count(*) AS raw_citations,
       round(sum({credit_sql(m.BASELINE, '1.0')}), 6) AS semantic_score,
       round(sum({credit_sql(m.BASELINE, '1.0')}) / count(*), 6) AS impact_multiplier
FROM cites GROUP BY cited_id""",
)
def baseline_ranking(t):
    ranked = m.baseline_ranking(t.cites)
    return ranked.select(
        "paper_id",
        "raw_citations",
        F.round("semantic_score", 6).alias("semantic_score"),
        F.round("impact_multiplier", 6).alias("impact_multiplier"),
    ).orderBy(F.desc("semantic_score"), "paper_id")


@query(
    "importance_ranking",
    "cites",
    f"""
SELECT cited_id AS paper_id, count(*) AS raw_citations,
       round(sum({credit_sql(m.BASELINE, '1.0')} * (importance + 0.1)), 6) AS semantic_hp_frac,
       round(sum({credit_sql(m.BASELINE, '1.0')} * (importance + 0.1)) - count(*), 6) AS impact_shift
FROM cites GROUP BY cited_id ORDER BY semantic_hp_frac DESC, paper_id LIMIT 15""",
)
def importance_ranking(t):
    scored = m.importance_scores(t.cites)
    rounded = scored.select(
        "paper_id",
        "raw_citations",
        F.round("semantic_hp_frac", 6).alias("semantic_hp_frac"),
        F.round("impact_shift", 6).alias("impact_shift"),
    )
    return m.leaderboard(rounded, "semantic_hp_frac", "paper_id", 15)


@query(
    "relative_importance",
    "predictions",
    """
SELECT citing_id, cited_id, n AS neighbourhood_size, round(semantic_weight * n, 6) AS relative_importance
FROM predictions JOIN (SELECT cited_id, count(*) AS n FROM predictions GROUP BY cited_id) USING (cited_id)""",
)
def relative_importance(t):
    return m.relative_importance(t.predictions).select(
        "citing_id",
        "cited_id",
        "neighbourhood_size",
        F.round("relative_importance", 6).alias("relative_importance"),
    )


EDGE_SCORES_SQL = f"""
  SELECT cited_id AS paper_id, count(*) AS raw_citations,
         sum(semantic_weight * n * {credit_sql(m.EVALUATION)}) AS semantic_citations
  FROM predictions JOIN (SELECT cited_id, count(*) AS n FROM predictions GROUP BY cited_id) USING (cited_id)
  GROUP BY cited_id"""


@query(
    "edge_score",
    "predictions",
    f"""
SELECT paper_id, raw_citations, round(semantic_citations, 6) AS semantic_citations
FROM ({EDGE_SCORES_SQL})""",
)
def edge_score(t):
    return m.edge_scores(t.predictions).withColumn(
        "semantic_citations", F.round("semantic_citations", 6)
    )


@query(
    "paper_impact",
    "predictions",
    """
SELECT cited_id AS cited_paper_id, round(sum(semantic_weight), 6) AS total_semantic_impact,
       count(*) AS raw_citation_count
FROM predictions GROUP BY cited_id""",
)
def paper_impact(t):
    return m.paper_impact(t.predictions).withColumn(
        "total_semantic_impact", F.round("total_semantic_impact", 6)
    )


@query(
    "hirsch",
    "cited_scores writes",
    f"""
, x AS (SELECT author_id, coalesce(CAST(s_c AS DOUBLE), 0) AS v
        FROM writes LEFT JOIN cited_scores USING (paper_id))
SELECT author_id, {h_sql('v', 'r')} AS h
FROM (SELECT *, {rank_sql('author_id', 'v')} AS r FROM x) GROUP BY author_id""",
)
def hirsch(t):
    scored = m.author_rows(t.writes, m.cited_scores(t.weighted)).withColumn(
        "v", F.coalesce("s_c", F.lit(0.0))
    )
    return m.hirsch(scored, "author_id", {"h": "v"})


@query("paper_h_2hop", "paper_h", "SELECT paper_id, h_p, sh_p FROM paper_h")
def paper_h_2hop(t):
    return m.paper_h_two_hop(t.weighted, m.cited_scores(t.weighted))


@query(
    "coauthor_count",
    "coauthors nodes",
    "SELECT n.paper_id, coalesce(a_i, 1) AS a_i FROM nodes n LEFT JOIN coauthors USING (paper_id)",
)
def coauthor_count(t):
    return m.with_coauthors(t.nodes.select("paper_id"), t.writes)


@query(
    "fractional_scores",
    "paper_h coauthors",
    """
SELECT p.paper_id, coalesce(a_i, 1) AS a_i, round(h_p / coalesce(a_i, 1), 6) AS frac_h_p,
       round(sh_p / coalesce(a_i, 1), 6) AS frac_sh_p
FROM paper_h p LEFT JOIN coauthors USING (paper_id)""",
)
def fractional_scores(t):
    h = m.paper_h_two_hop(t.weighted, m.cited_scores(t.weighted))
    return m.fractional_scores(h, t.writes).select(
        "paper_id",
        "a_i",
        F.round("frac_h_p", 6).alias("frac_h_p"),
        F.round("frac_sh_p", 6).alias("frac_sh_p"),
    )


HP_FRAC_SQL = f"""
  SELECT author_id, count(*) AS total_papers, {h_sql('normal', 'r1')} AS normal_hp_frac,
         {h_sql('semantic', 'r2')} AS semantic_hp_frac,
         {h_sql('semantic', 'r2')} - {h_sql('normal', 'r1')} AS impact_shift
  FROM (SELECT *, {rank_sql('author_id', 'normal')} AS r1, {rank_sql('author_id', 'semantic')} AS r2
        FROM (SELECT author_id, coalesce(h_p, 0) / a_i AS normal, coalesce(sh_p, 0) / a_i AS semantic
              FROM writes JOIN coauthors USING (paper_id) LEFT JOIN paper_h USING (paper_id)))
  GROUP BY author_id HAVING {h_sql('normal', 'r1')} > 0"""


@query("hp_frac", "paper_h coauthors", HP_FRAC_SQL)
def hp_frac(t):
    return m.hp_frac(t.weighted, t.writes).orderBy(F.desc("semantic_hp_frac"), "author_id")


@query("hp_frac_refreshed", "paper_h coauthors", HP_FRAC_SQL)
def hp_frac_refreshed(t):
    """The ranking after three quarters of the citations arrived first and the rest later; few, small folders."""
    out = new_path(t.spark, "ranking")
    edges = t.weighted.select("citing_id", "cited_id", "semantic_weight")
    late = F.crc32(F.concat("citing_id", "cited_id")) % 4 == 0
    ranking.start(t.writes, out, buckets=8)
    ranking.add_citations(edges.where(~late), out, 1, buckets=8)
    ranking.add_citations(edges.where(late), out, 2, buckets=8)
    return ranking.ranking(t.spark, out)


@query(
    "leaderboard",
    "paper_h coauthors",
    f"SELECT * FROM ({HP_FRAC_SQL}) ORDER BY semantic_hp_frac DESC, author_id LIMIT 10",
)
def leaderboard(t):
    return m.leaderboard(m.hp_frac(t.weighted, t.writes), "semantic_hp_frac", "author_id", 10)


@query(
    "hp_frac_raw",
    "paper_h coauthors",
    f"""
SELECT author_id, count(*) AS total_papers, CAST(sum(raw) AS BIGINT) AS total_raw_citations,
       {h_sql('raw', 'r0')} AS h_index, {h_sql('fr', 'r1')} AS standard_hp_frac,
       {h_sql('fs', 'r2')} AS semantic_hp_frac, {h_sql('fs', 'r2')} - {h_sql('fr', 'r1')} AS impact_shift
FROM (SELECT *, {rank_sql('author_id', 'raw')} AS r0, {rank_sql('author_id', 'fr')} AS r1,
             {rank_sql('author_id', 'fs')} AS r2
      FROM (SELECT author_id, coalesce(raw, 0) AS raw, coalesce(raw, 0) / a_i AS fr,
                   coalesce(sh_p, 0) / a_i AS fs
            FROM writes JOIN coauthors USING (paper_id) LEFT JOIN paper_h USING (paper_id)
            LEFT JOIN cited_scores USING (paper_id)))
GROUP BY author_id""",
)
def hp_frac_raw(t):
    return m.hp_frac_raw(t.weighted, t.writes)


# Every author row of a part with its position; the type LARGE is listed without an id.
LISTED_SQL = """
  SELECT paper_id, author_id, author_id AS author_name,
         CASE WHEN starts_with(author_id, 'Brand') THEN 0 WHEN starts_with(author_id, 'S') THEN 2 ELSE 1 END
           AS position
  FROM (SELECT paper_id, CASE WHEN author_id <> 'LARGE' THEN author_id END AS author_id FROM writes)"""


def listed_authors(t):
    a = F.col("author_id")
    return t.writes.select(
        "paper_id",
        F.when(a != "LARGE", a).alias("author_id"),
        F.when(a != "LARGE", a).alias("author_name"),
        F.when(a.startswith("Brand"), 0).when(a.startswith("S"), 2).otherwise(1).alias("position"),
    )


@query(
    "author_fractional_sum",
    "predictions writes",
    f"""
, s AS ({EDGE_SCORES_SQL}),
listed AS ({LISTED_SQL}),
r AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n FROM listed),
v AS (SELECT * FROM r JOIN s USING (paper_id) WHERE author_id IS NOT NULL)
SELECT author_id, max(author_name) AS author_name, round(sum(raw_citations / n), 6) AS normal,
       round(sum(semantic_citations / n), 2) AS semantic, {h_sql('raw_citations', 'r')} AS h_index
FROM (SELECT *, {rank_sql('author_id', 'raw_citations')} AS r FROM v) GROUP BY author_id
HAVING {h_sql('raw_citations', 'r')} > 0""",
)
def author_fractional_sum(t):
    sums = m.author_fractional_sum(m.edge_scores(t.predictions), listed_authors(t))
    return sums.withColumn("normal", F.round("normal", 6))


IMPACT_SQL = """
  SELECT cited_id AS cited_paper_id, sum(semantic_weight) AS total_semantic_impact,
         count(*) AS raw_citation_count
  FROM predictions GROUP BY cited_id"""


@query(
    "author_impact_by_name",
    "predictions clean0",
    f"""
SELECT trim(author, ' ') AS author, round(sum(total_semantic_impact), 6) AS total_semantic_impact,
       CAST(sum(raw_citation_count) AS BIGINT) AS raw_citation_count, count(*) AS local_paper_count
FROM (SELECT i.*, unnest(string_split(authors, ',')) AS author
      FROM ({IMPACT_SQL}) i JOIN clean0 ON source_paper_id = cited_paper_id)
GROUP BY 1 HAVING length(trim(author, ' ')) > 1""",
)
def author_impact_by_name(t):
    analytics = m.join_metadata(m.paper_impact(t.predictions), t.cleaned[0])
    return m.author_impact_by_name(analytics).withColumn(
        "total_semantic_impact", F.round("total_semantic_impact", 6)
    )


@query(
    "fallback_join",
    "predictions clean0",
    f"""
SELECT cited_paper_id, round(total_semantic_impact, 6) AS total_semantic_impact, raw_citation_count,
       source_paper_id AS paper_id, title, authors, year
FROM ({IMPACT_SQL}) JOIN clean0 ON source_paper_id = cited_paper_id""",
)
def fallback_join(t):
    # `paper_id` holds another id scheme here, so the first join finds nothing.
    meta = t.cleaned[0].withColumn("paper_id", F.concat(F.lit("doi:"), "source_paper_id"))
    return m.join_metadata(m.paper_impact(t.predictions), meta).withColumn(
        "total_semantic_impact", F.round("total_semantic_impact", 6)
    )


@query(
    "resolve_columns",
    "seeds_meta",
    "SELECT source_paper_id AS paper_id, authors FROM seeds_meta",
)
def resolve_columns(t):
    names = m.resolve_columns(t.seeds_meta.columns, m.META_ALIASES)
    return t.seeds_meta.select(F.col(names["id"]).alias("paper_id"), F.col(names["authors"]).alias("authors"))


@query(
    "influence_share",
    "predictions coauthors",
    f"""
, s AS ({EDGE_SCORES_SQL}),
a AS (SELECT author_id, sum(raw_citations / a_i) AS normal, sum(semantic_citations / a_i) AS semantic
      FROM writes JOIN coauthors USING (paper_id) JOIN s USING (paper_id) GROUP BY author_id)
SELECT author_id, round(normal, 6) AS normal, round(semantic, 6) AS semantic,
       round(normal / (SELECT sum(normal) FROM a) * 100, 6) AS normal_percent,
       round(semantic / (SELECT sum(semantic) FROM a) * 100, 6) AS semantic_percent
FROM a""",
)
def influence_share(t):
    rows = m.author_rows(t.writes, m.edge_scores(t.predictions)).where("raw_citations is not null")
    pools = rows.groupBy("author_id").agg(
        F.sum(F.col("raw_citations") / F.col("a_i")).alias("normal"),
        F.sum(F.col("semantic_citations") / F.col("a_i")).alias("semantic"),
    )
    shares = m.influence_share(pools, ["normal", "semantic"])
    return shares.select("author_id", *[F.round(c, 6).alias(c) for c in shares.columns[1:]])


@query(
    "intent_distribution",
    "cites",
    """
SELECT intent, count(*) AS count, round(count(*) / (SELECT count(*) FROM cites) * 100, 1) AS percent
FROM cites GROUP BY intent""",
)
def intent_distribution(t):
    return m.intent_distribution(t.cites)


@query(
    "weight_histogram",
    "predictions",
    """
, x AS (SELECT least(semantic_weight * n, 5.0) AS x
        FROM predictions JOIN (SELECT cited_id, count(*) AS n FROM predictions GROUP BY cited_id)
        USING (cited_id)),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50.0)), 49) AS INTEGER) AS bin, count(*) AS n
      FROM x, lim GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * (hi - lo) / 50.0, 6) AS bin_start,
       coalesce(n, 0) AS count
FROM range(50) g(i) CROSS JOIN lim LEFT JOIN b ON b.bin = g.i""",
)
def weight_histogram(t):
    hist = m.histogram(m.relative_importance(t.predictions), "relative_importance", clip=5.0)
    return hist.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "weight_histogram_raw",
    "weighted",
    """
, x AS (SELECT CAST(semantic_weight AS DOUBLE) AS x FROM weighted),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50.0)), 49) AS INTEGER) AS bin, count(*) AS n
      FROM x, lim GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * (hi - lo) / 50.0, 6) AS bin_start,
       coalesce(n, 0) AS count
FROM range(50) g(i) CROSS JOIN lim LEFT JOIN b ON b.bin = g.i""",
)
def weight_histogram_raw(t):
    return m.histogram(t.weighted, "semantic_weight").withColumn("bin_start", F.round("bin_start", 6))


@query(
    "decay_curve",
    "training_log",
    """
SELECT CAST(i AS INTEGER) AS step, round(i * 50.0 / 99, 6) AS delta_t,
       round(exp(-abs((SELECT arg_max(lam, epoch) FROM training_log)) * (i * 50.0 / 99)), 6) AS decay
FROM range(100) g(i)""",
)
def decay_curve(t):
    curve = m.decay_curve(t.training_log)
    return curve.select("step", F.round("delta_t", 6).alias("delta_t"), F.round("decay", 6).alias("decay"))
