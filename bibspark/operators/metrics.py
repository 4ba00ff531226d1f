"""Citation weights, real-valued Hirsch indexes and fractional author rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.skew import spread_join

# Credit per intent in the three published weightings.
SCALED = {"Background": 0.5, "Method": 1.5, "Result": 1.2}
EVALUATION = {"Background": 0.5, "Result": 1.0, "Method": 2.0, "Unknown": 1.0}
BASELINE = {"Background": 1.0, "Method": 1.5, "Result": 1.2}
IMPORTANCE_FLOOR = 0.1

# Sums of doubles may land a hair off an integer depending on addition order.
DIGITS = 9


def intent_multiplier(intent: Column, weights: dict[str, float] = SCALED) -> Column:
    """Credit of an intent; null for an intent the weighting does not know."""
    return reduce(
        lambda acc, kv: acc.when(intent == kv[0], F.lit(float(kv[1]))), weights.items(), F
    )


def decay(lam: Column | float, delta_t: Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.exp(-F.abs(lam) * delta_t)


def weigh_edges(edges: DataFrame, lam: Column | float, weights: dict[str, float] = SCALED) -> DataFrame:
    """Adds multiplier, decay factor and semantic weight to (…, intent, delta_t)."""
    return (
        edges.withColumn("intent_multiplier", intent_multiplier(F.col("intent"), weights))
        .withColumn("decay_factor", decay(lam, F.col("delta_t")))
        .withColumn("semantic_weight", F.col("intent_multiplier") * F.col("decay_factor"))
    )


def cited_scores(edges: DataFrame, weight: str = "semantic_weight") -> DataFrame:
    """(paper_id, s_c, raw) for every cited paper."""
    return edges.groupBy(F.col("cited_id").alias("paper_id")).agg(
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("s_c"), F.count(F.lit(1)).alias("raw")
    )


def paper_scores(papers: DataFrame, edges: DataFrame, weight: str = "semantic_weight") -> DataFrame:
    """Score and raw count of every paper, zeros for the uncited."""
    return (
        papers.select("paper_id")
        .join(cited_scores(edges, weight), "paper_id", "left")
        .select(
            "paper_id",
            F.coalesce("s_c", F.lit(0.0)).alias("s_c"),
            F.coalesce("raw", F.lit(0)).cast("bigint").alias("raw"),
        )
    )


def whole(value: Column) -> Column:
    """The whole number that counts of a value: negative ones count as zero."""
    return F.greatest(F.floor(F.round(value.cast("double"), DIGITS)), F.lit(0)).cast("bigint")


def whole_counts(df: DataFrame, group: str, values: dict[str, str]) -> DataFrame:
    """(group, m, v, n): how many rows of a group have the whole value v in the column named m."""
    floors = F.explode(
        F.array(*[F.struct(F.lit(name).alias("m"), whole(F.col(c)).alias("v")) for name, c in values.items()])
    )
    return (
        df.select(group, floors.alias("x"))
        .groupBy(group, F.col("x.m").alias("m"), F.col("x.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hirsch_of_counts(
    counts: DataFrame, group: str, names: list[str], count_as: str | None = None, placed: bool = False
) -> DataFrame:
    """Per group and name, the largest i such that i values are at least i, from `whole_counts`.

    `placed` says that the counts are partitioned by group already: they are not shuffled again.
    """
    above = Window.partitionBy(group, "m").orderBy(F.desc("v"))
    rows = counts if placed else counts.repartition(group)
    ranked = rows.withColumn("at_least", F.sum("n").over(above))
    aggs = [
        F.max(F.when(F.col("m") == name, F.least("v", "at_least"))).cast("double").alias(name)
        for name in names
    ]
    if count_as:
        aggs.append(F.sum(F.when(F.col("m") == names[0], F.col("n"))).alias(count_as))
    return ranked.groupBy(group).agg(*aggs)


def hirsch(
    df: DataFrame, group: str, values: dict[str, str], count_as: str | None = None
) -> DataFrame:
    """Per group and value column, the largest i such that i values are at least i.

    Ranks are whole numbers, so only floor(value) matters. Counting rows per
    (group, floor) combines on the map side; what remains of a group is one row
    per distinct whole value, whatever the size of the group. With N(v) values at
    or above v, the index is the largest min(v, N(v)).
    """
    return hirsch_of_counts(whole_counts(df, group, values), group, list(values), count_as)


def paper_h_two_hop(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """h_p and sh_p: Hirsch over raw counts and scores of the papers citing p."""
    citing = scores.select(F.col("paper_id").alias("citing_id"), "s_c", "raw")
    scored = spread_join(edges.select("citing_id", "cited_id"), citing, "citing_id", "left").select(
        F.col("cited_id").alias("paper_id"),
        F.coalesce("raw", F.lit(0)).alias("raw"),
        F.coalesce("s_c", F.lit(0.0)).alias("s_c"),
    )
    return hirsch(scored, "paper_id", {"h_p": "raw", "sh_p": "s_c"})


def coauthor_count(writes: DataFrame) -> DataFrame:
    """a_i: author rows per paper (rows, not distinct authors)."""
    return writes.groupBy("paper_id").agg(F.count(F.lit(1)).alias("a_i"))


def with_coauthors(papers: DataFrame, writes: DataFrame) -> DataFrame:
    """Papers with a_i; a paper without author rows counts as one."""
    return papers.join(coauthor_count(writes), "paper_id", "left").withColumn(
        "a_i", F.coalesce("a_i", F.lit(1)).cast("bigint")
    )


def fractional_scores(paper_h: DataFrame, writes: DataFrame) -> DataFrame:
    return with_coauthors(paper_h, writes).select(
        "paper_id",
        "a_i",
        (F.col("h_p") / F.col("a_i")).alias("frac_h_p"),
        (F.col("sh_p") / F.col("a_i")).alias("frac_sh_p"),
    )


def author_rows(writes: DataFrame, paper_values: DataFrame) -> DataFrame:
    """Author rows with a_i and the paper's values."""
    per_paper = coauthor_count(writes).join(paper_values, "paper_id", "left")
    # Counted on the author rows: taking a_i from `per_paper` would compute its join twice.
    return spread_join(writes.select("author_id", "paper_id"), per_paper, "paper_id")


def hp_frac(edges: DataFrame, writes: DataFrame) -> DataFrame:
    """Author ranking from weighted edges: normal and semantic hp-frac and their shift."""
    paper_h = paper_h_two_hop(edges, cited_scores(edges))
    rows = author_rows(writes, paper_h).select(
        "author_id",
        (F.coalesce("h_p", F.lit(0.0)) / F.col("a_i")).alias("normal"),
        (F.coalesce("sh_p", F.lit(0.0)) / F.col("a_i")).alias("semantic"),
    )
    return (
        hirsch(
            rows,
            "author_id",
            {"normal_hp_frac": "normal", "semantic_hp_frac": "semantic"},
            count_as="total_papers",
        )
        .where(F.col("normal_hp_frac") > 0)
        .withColumn("impact_shift", F.col("semantic_hp_frac") - F.col("normal_hp_frac"))
    )


def hp_frac_raw(edges: DataFrame, writes: DataFrame) -> DataFrame:
    """Variant on raw citations: plain h, H(raw/a), H(sh/a) and total citations."""
    scores = cited_scores(edges)
    paper_values = scores.select("paper_id", "raw").join(
        paper_h_two_hop(edges, scores).select("paper_id", "sh_p"), "paper_id", "left"
    )
    rows = author_rows(writes, paper_values).select(
        "author_id",
        F.coalesce("raw", F.lit(0)).alias("raw"),
        (F.coalesce("raw", F.lit(0)) / F.col("a_i")).alias("frac_raw"),
        (F.coalesce("sh_p", F.lit(0.0)) / F.col("a_i")).alias("frac_sh"),
    )
    totals = rows.groupBy("author_id").agg(F.sum("raw").alias("total_raw_citations"))
    h = hirsch(
        rows,
        "author_id",
        {"h_index": "raw", "standard_hp_frac": "frac_raw", "semantic_hp_frac": "frac_sh"},
        count_as="total_papers",
    )
    return h.join(totals, "author_id").withColumn(
        "impact_shift", F.col("semantic_hp_frac") - F.col("standard_hp_frac")
    )


def leaderboard(df: DataFrame, by: str, key: str, k: int = 10) -> DataFrame:
    """The k best rows; ties go to the smaller key."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(k)


def baseline_ranking(edges: DataFrame) -> DataFrame:
    """Intent-weighted score of each cited paper and its ratio to the raw count."""
    return (
        edges.groupBy(F.col("cited_id").alias("paper_id"))
        .agg(
            F.count(F.lit(1)).alias("raw_citations"),
            F.sum(F.coalesce(intent_multiplier(F.col("intent"), BASELINE), F.lit(1.0))).alias(
                "semantic_score"
            ),
        )
        .withColumn("impact_multiplier", F.col("semantic_score") / F.col("raw_citations"))
    )


def importance_scores(edges: DataFrame, importance: str = "importance") -> DataFrame:
    """Per cited paper the sum of multiplier · (importance + 0.1), and its shift from the raw count."""
    weight = F.coalesce(intent_multiplier(F.col("intent"), BASELINE), F.lit(1.0)) * (
        F.col(importance) + F.lit(IMPORTANCE_FLOOR)
    )
    return (
        edges.groupBy(F.col("cited_id").alias("paper_id"))
        .agg(F.count(F.lit(1)).alias("raw_citations"), F.sum(weight).alias("semantic_hp_frac"))
        .withColumn("impact_shift", F.col("semantic_hp_frac") - F.col("raw_citations"))
    )


def relative_importance(edges: DataFrame, weight: str = "semantic_weight") -> DataFrame:
    """Adds the neighbourhood size of the cited paper and weight · size."""
    sizes = edges.groupBy("cited_id").agg(F.count(F.lit(1)).alias("neighbourhood_size"))
    sized = spread_join(edges, sizes, "cited_id", rows="neighbourhood_size")
    return sized.withColumn("relative_importance", F.col(weight) * F.col("neighbourhood_size"))


def edge_scores(edges: DataFrame, weight: str = "semantic_weight") -> DataFrame:
    """Per cited paper the raw count and the sum of relative importance · evaluation credit.

    The neighbourhood size is the same for all edges of a paper, so the sum is
    taken first and multiplied once: one aggregation, no join back to the edges.
    """
    credit = F.col(weight) * intent_multiplier(F.col("intent"), EVALUATION)
    return (
        edges.groupBy(F.col("cited_id").alias("paper_id"))
        .agg(F.count(F.lit(1)).alias("raw_citations"), F.sum(credit).alias("_sum"))
        .select(
            "paper_id",
            "raw_citations",
            (F.coalesce("_sum", F.lit(0.0)) * F.col("raw_citations")).alias("semantic_citations"),
        )
    )


def paper_impact(edges: DataFrame, weight: str = "semantic_weight") -> DataFrame:
    return edges.groupBy(F.col("cited_id").alias("cited_paper_id")).agg(
        F.sum(weight).alias("total_semantic_impact"), F.count("citing_id").alias("raw_citation_count")
    )


def author_fractional_sum(scores: DataFrame, authors: DataFrame) -> DataFrame:
    """Fractional sums and a local h per author over scored papers.

    `authors` holds one row per listed author (paper_id, position, author_id,
    author_name); those without an id still count towards a paper's author
    number. Of several names of one id the one on the last paper is kept.
    """
    sized = authors.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    per_paper = sized.join(scores, "paper_id")
    rows = spread_join(authors.where("author_id is not null and author_id <> ''"), per_paper, "paper_id")
    sums = rows.groupBy("author_id").agg(
        F.max_by(
            F.coalesce("author_name", F.concat(F.lit("Author_"), F.col("author_id"))),
            F.struct("paper_id", "position"),
        ).alias("author_name"),
        F.sum(F.col("raw_citations") / F.col("n")).alias("normal"),
        F.round(F.sum(F.col("semantic_citations") / F.col("n")), 2).alias("semantic"),
    )
    h = hirsch(rows, "author_id", {"h_index": "raw_citations"}).where("h_index > 0")
    return sums.join(h, "author_id")


def resolve_columns(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """The first present alias of each wanted column; an error names what is missing."""
    found = {want: next((a for a in names if a in columns), None) for want, names in aliases.items()}
    missing = [want for want, name in found.items() if name is None]
    if missing:
        raise ValueError(f"no column for {missing} among {columns}")
    return found


META_ALIASES = {"id": ["paper_id", "source_paper_id"], "authors": ["authors", "author_names"]}


def join_metadata(impact: DataFrame, meta: DataFrame) -> DataFrame:
    """Impact rows with title, authors and year; falls back to the source ids if nothing matches."""
    names = resolve_columns(meta.columns, META_ALIASES)

    def joined(id_col: str, authors: str) -> DataFrame:
        return impact.join(
            meta.select(
                F.col(id_col).alias("paper_id"), "title", F.col(authors).alias("authors"), "year"
            ),
            F.col("cited_paper_id") == F.col("paper_id"),
        )

    first = joined(names["id"], names["authors"])
    if "source_paper_id" in meta.columns and names["id"] != "source_paper_id" and first.isEmpty():
        return joined("source_paper_id", "authors")
    return first


def author_impact_by_name(analytics: DataFrame) -> DataFrame:
    """Impact, citations and papers per author name of a comma-separated list."""
    return (
        analytics.withColumn("author", F.explode(F.split("authors", ",", -1)))
        .withColumn("author", F.trim("author"))
        .groupBy("author")
        .agg(
            F.sum("total_semantic_impact").alias("total_semantic_impact"),
            F.sum("raw_citation_count").alias("raw_citation_count"),
            F.count("paper_id").alias("local_paper_count"),
        )
        .where(F.length("author") > 1)
    )


def influence_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of each column's total that a row holds; one pass for all totals."""
    totals = df.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    return df.withColumn("_totals", totals).select(
        *df.columns, *[(F.col(c) / F.col("_totals").getField(c) * 100).alias(f"{c}_percent") for c in columns]
    )


def intent_distribution(edges: DataFrame, intent: str = "intent") -> DataFrame:
    total = edges.agg(F.count(F.lit(1)))
    return (
        edges.groupBy(intent)
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("percent", F.round(F.col("count") / total.scalar() * 100, 1))
    )


def histogram(df: DataFrame, value: str, bins: int = 50, clip: float | None = None) -> DataFrame:
    """Counts of equal bins between the least and greatest value, empty bins included.

    The last bin is closed on the right.
    """
    x = F.least(F.col(value), F.lit(float(clip))) if clip is not None else F.col(value)
    data = df.select(x.cast("double").alias("x")).where("x is not null")
    ends = data.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    binned = data.withColumn("lo", lo).withColumn("width", (hi - lo) / F.lit(float(bins)))
    bin_no = F.when(
        F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    ).otherwise(F.lit(0))
    counted = binned.groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * (hi - lo) / F.lit(float(bins))).alias("bin_start"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def decay_curve(log: DataFrame, upto: float = 50.0, points: int = 100) -> DataFrame:
    """exp(-|λ|·t) at evenly spaced t, for the last λ of a training log."""
    lam = log.agg(F.max_by("lambda", "epoch")).scalar()
    t = F.col("id") * F.lit(upto) / F.lit(float(points - 1))
    return log.sparkSession.range(points).select(
        F.col("id").cast("int").alias("step"), t.alias("delta_t"), decay(lam, t).alias("decay")
    )
