"""Normalisation, validation, deduplication and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import text as tx
from bibspark.skew import keep_first, spread_join

# The final layout, the stand-ins for missing fields, the label and year that mean "unknown".
FINAL_COLUMNS = ["paper_id", "title", "abstract", "authors", "year", "source"]
REASON = "failed_validation"
NO_ABSTRACT = "No abstract available"
NO_TITLE = "Unknown Title"
NO_CONTEXT = "Citation context missing."
UNKNOWN_LABEL = "unknown"
FALLBACK_YEAR = 2018


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """By-name bag union with year as int."""
    out = None
    for feed in feeds:
        feed = feed.withColumn("year", F.col("year").cast("int"))
        out = feed if out is None else out.unionByName(feed)
    return out


def is_valid() -> Column:
    return F.col("abstract").isNotNull() & F.col("year").isNotNull() & (F.size("authors") > 0)


def valid_papers(raw: DataFrame) -> DataFrame:
    return raw.where(is_valid())


def rejected_papers(raw: DataFrame) -> DataFrame:
    """The distinct rows that fail validation, with a reason.

    All − valid as a set difference: the predicate decides row by row, so the
    negated (null-safe) filter and a distinct give the same rows in one scan.
    """
    failed = raw.where(~F.coalesce(is_valid(), F.lit(False))).distinct()
    return failed.withColumn("reason", F.lit(REASON))


def normalise(papers: DataFrame) -> DataFrame:
    """Lower-cased title and abstract, and the paper key over title and year."""
    return (
        papers.withColumn("title", F.lower("title"))
        .withColumn("abstract", F.lower("abstract"))
        .withColumn("paper_id", tx.paper_key(F.col("title"), F.col("year")))
    )


def dedup_papers(papers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per paper key: first by `order`, by default source, authors, abstract."""
    return keep_first(papers, ["paper_id"], order or ["source", "authors", "abstract"])


def final_layout(papers: DataFrame) -> DataFrame:
    return papers.withColumn("year", F.col("year").cast("int")).select(*FINAL_COLUMNS)


def strip_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids without surrounding blanks; rows with a null id are dropped."""
    for c in columns:
        df = df.withColumn(c, tx.strip_blanks(F.col(c)))
    return df.na.drop(subset=columns)


def is_unknown_label(label: Column) -> Column:
    return label.isNull() | (F.lower(label) == UNKNOWN_LABEL)


def dedup_labelled(hop1: DataFrame, order: list[str]) -> DataFrame:
    """One row per (hop1_id, hop0_id): real labels first, alphabetically, then `order`."""
    label = F.col("intent_label")
    return keep_first(
        hop1, ["hop1_id", "hop0_id"], [is_unknown_label(label), label.isNull(), label, *order]
    )


def cross_layer_dedup(hop2: DataFrame, hop1: DataFrame) -> DataFrame:
    """Drops second-layer edges that the first layer holds as the same (citing, cited) pair."""
    known = hop1.select(F.col("hop1_id").alias("hop2_id"), F.col("hop0_id").alias("hop1_id"))
    return hop2.join(known, ["hop2_id", "hop1_id"], "left_anti")


def clean_layers(
    hop0: DataFrame, hop1: DataFrame, hop2: DataFrame, order: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stripped ids, one row per key in each layer, no edge in two layers."""
    h0_order = [c for c in order if c in hop0.columns]
    h0 = keep_first(strip_ids(hop0, ["source_paper_id"]), ["source_paper_id"], h0_order)
    h1 = dedup_labelled(strip_ids(hop1, ["hop1_id", "hop0_id"]), order)
    h2 = keep_first(strip_ids(hop2, ["hop2_id", "hop1_id"]), ["hop2_id", "hop1_id"], order)
    return h0, h1, cross_layer_dedup(h2, h1)


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(stage, rows) for each named DataFrame."""
    out = None
    for name, df in stages.items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def median_year(*years: DataFrame) -> DataFrame:
    """One row, one column: the truncated median over single-column year tables, else 2018."""
    out = None
    for y in years:
        y = y.toDF("year")
        out = y if out is None else out.unionByName(y)
    return out.agg(
        F.coalesce(F.percentile("year", 0.5).cast("int"), F.lit(FALLBACK_YEAR)).alias("median_year")
    )


def impute_missing(
    df: DataFrame, text_col: str, title_col: str, year_col: str, default_year: Column | int = 2020
) -> DataFrame:
    """Year, then abstract from the (still raw) title, then title."""
    default = default_year if isinstance(default_year, Column) else F.lit(default_year)
    return (
        df.withColumn(year_col, F.coalesce(F.col(year_col), default).cast("int"))
        .withColumn(text_col, F.coalesce(F.col(text_col), F.col(title_col), F.lit(NO_ABSTRACT)))
        .withColumn(title_col, F.coalesce(F.col(title_col), F.lit(NO_TITLE)))
    )


def fill_context(df: DataFrame, column: str = "citation_text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(NO_CONTEXT)))


def needs_rescue(df: DataFrame) -> DataFrame:
    """Rows whose abstract is null or blank, or whose year is missing."""
    return df.where(tx.non_blank(F.col("abstract")).isNull() | F.col("year").isNull())


def ghost_ids(hop0: DataFrame, hop1: DataFrame) -> DataFrame:
    """Distinct cited ids that the seed table does not hold."""
    cited = hop1.select(F.col("hop0_id").alias("source_paper_id")).na.drop().distinct()
    return cited.join(hop0.select("source_paper_id"), "source_paper_id", "left_anti")


# Rescue sources in the order they are asked.
TIERS = ["s2_single", "openalex", "crossref"]
TITLE_TIERS = {"openalex", "crossref"}


def tiered_fill(papers: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """Fill abstract and year, each on its own, from the first tier that has it.

    `papers` is (source_paper_id, title, abstract, year, source); every tier is
    (source_paper_id, abstract, year), one row per paper. The title-search tiers
    are not asked for a paper without a title. `source` of a paper that needed
    rescue becomes the tier after which both fields were there; `crossref` if by
    then anything is filled; else `none`.
    """
    df = papers
    for name in TIERS:
        hit = tiers[name].select(
            "source_paper_id", F.col("abstract").alias(f"_a_{name}"), F.col("year").alias(f"_y_{name}")
        )
        df = df.join(hit, "source_paper_id", "left")
    has_title = F.coalesce("title", F.lit("")) != ""

    def field(base: Column, prefix: str, upto: int, clean) -> Column:
        cols = [clean(base)]
        for name in TIERS[:upto]:
            value = clean(F.col(f"_{prefix}_{name}"))
            cols.append(F.when(has_title, value) if name in TITLE_TIERS else value)
        return F.coalesce(*cols)

    def year(c: Column) -> Column:
        return F.when(c != 0, c)

    a0, y0 = tx.non_blank(F.col("abstract")), F.col("year")
    a = [field(F.col("abstract"), "a", i, tx.non_blank) for i in range(4)]
    y = [F.coalesce(y0, field(y0, "y", i, year)) for i in range(4)]
    needed = a0.isNull() | y0.isNull()

    def done(i: int) -> Column:
        return a[i].isNotNull() & y[i].isNotNull()

    # A tier is only credited while it was asked, that is with something missing.
    method = (
        F.when(done(1), "s2_single")
        .when(done(2) & has_title, "openalex")
        .when(has_title & (a[3].isNotNull() | y[3].isNotNull()), "crossref")
        .otherwise("none")
    )
    return df.select(
        "source_paper_id",
        "title",
        F.coalesce(a[3], F.col("abstract")).alias("abstract"),
        y[3].cast("int").alias("year"),
        F.when(needed, method).otherwise(F.col("source")).alias("source"),
    )


# Author sources in the order they are asked, and the last resort.
AUTHOR_TIERS = ["S2", "OpenAlex", "CrossRef"]
DUMMY_SOURCE = "Dummy_Gen"


def synth_author_ids(authors: DataFrame) -> DataFrame:
    """Gives authors without id a name-free one made of paper and position."""
    made = F.concat_ws("_", F.lit("s2_unknown"), "paper_id", F.col("position").cast("string"))
    return authors.withColumn(
        "author_id", F.coalesce(F.when(F.col("author_id") != "", F.col("author_id")), made)
    )


def tiered_authors(paper_ids: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """Author rows of each paper from its first source that has any; else one dummy row.

    Every tier is (paper_id, author_id, author_name). The best source per paper
    is a map-side combined min; no paper's rows are gathered in one place for it.
    """
    rows = None
    for i, name in enumerate(AUTHOR_TIERS):
        t = tiers[name].select(
            "paper_id", "author_id", "author_name", F.lit(name).alias("source"), F.lit(i).alias("tier")
        )
        rows = t if rows is None else rows.unionByName(t)
    best = rows.groupBy("paper_id").agg(F.min("tier").alias("best"))
    wanted = paper_ids.select("paper_id").distinct()
    kept = spread_join(rows, best.join(wanted, "paper_id", "left_semi"), "paper_id").where(
        F.col("tier") == F.col("best")
    )
    dummy = wanted.join(best, "paper_id", "left_anti").select(
        "paper_id",
        F.concat(F.lit("final_unknown_"), F.col("paper_id"), F.lit("_0")).alias("author_id"),
        F.lit("Unknown").alias("author_name"),
        F.lit(DUMMY_SOURCE).alias("source"),
    )
    return kept.select("paper_id", "author_id", "author_name", "source").unionByName(dummy)


def merge_rescued(original: DataFrame, rescued: DataFrame) -> DataFrame:
    """Original rows first, rescued rows for ids the original lacks."""
    columns = [c for c in original.columns if c in rescued.columns]
    ranked = original.select(*columns, F.lit(0).alias("_rank")).unionByName(
        rescued.select(*columns, F.lit(1).alias("_rank"))
    )
    return keep_first(ranked, ["source_paper_id"], ["_rank"]).drop("_rank")


def rescue_report(rescued: DataFrame) -> DataFrame:
    """(item, count, percent): papers with abstract, with year, and per source."""
    has_abstract = tx.non_blank(F.col("abstract")).isNotNull()
    has_year = F.col("year").isNotNull()
    items = rescued.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("item"), F.lit(True).alias("hit")),
                F.struct(F.lit("with_abstract").alias("item"), has_abstract.alias("hit")),
                F.struct(F.lit("with_year").alias("item"), has_year.alias("hit")),
                F.struct(F.concat(F.lit("via_"), "source").alias("item"), F.lit(True).alias("hit")),
            )
        ).alias("x")
    )
    total = rescued.agg(F.count(F.lit(1)))
    return (
        items.groupBy(F.col("x.item").alias("item"))
        .agg(F.count_if(F.col("x.hit")).alias("count"))
        .withColumn("percent", F.round(F.col("count") * 100 / total.scalar(), 1))
    )


def referential_cascade(
    hop0: DataFrame, hop1: DataFrame, hop2: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """First-layer rows that cite a known seed; second-layer rows that cite a kept first-layer paper."""
    seeds = hop0.select(F.col("source_paper_id").alias("hop0_id")).distinct()
    kept1 = spread_join(hop1, seeds, "hop0_id", "left_semi")
    kept2 = spread_join(
        hop2, kept1.select("hop1_id").distinct(), "hop1_id", "left_semi"
    )
    return kept1, kept2


def flag_to_float(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def present_search(papers: DataFrame) -> DataFrame:
    """Search hits laid out for reading."""
    return papers.select(
        tx.title_case(F.col("title")).alias("title"),
        F.array_join("authors", ", ").alias("authors"),
        "year",
        F.upper("source").alias("source"),
    )
