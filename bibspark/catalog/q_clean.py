"""Normalisation, quality and cleaning queries."""

from pyspark.sql import functions as F

from bibspark.catalog import payloads as pay
from bibspark.catalog.registry import query
from bibspark.functions import text as tx
from bibspark.operators import clean, titles
from bibspark.session import land

BLANKS = "' ' || chr(9) || chr(10)"


@query(
    "year_from_date",
    "raw_docs",
    """
SELECT doc_id, TRY_CAST(substr(stamp, 1, 4) AS INTEGER) AS year
FROM (SELECT doc_id, CASE WHEN len(authors) = 0 THEN 'abcd-01-01'
             ELSE CAST(year AS VARCHAR) || '-11-26' END AS stamp FROM raw_docs)""",
)
def year_from_date(t):
    stamp = F.when(F.size("authors") == 0, "abcd-01-01").otherwise(
        F.concat(F.col("year").cast("string"), F.lit("-11-26"))
    )
    return t.raw_docs.select("doc_id", tx.year_from_date(stamp).alias("year"))


@query(
    "authors_nested",
    "raw_docs",
    """
SELECT doc_id, array_to_string(list_transform(authors, lambda a:
         CASE WHEN contains(a, ' ') THEN split_part(a, ' ', 2) || ' ' || split_part(a, ' ', 1)
              ELSE a END), '|') AS authors
FROM raw_docs""",
)
def authors_nested(t):
    parsed = t.raw_docs.select("doc_id", F.transform("authors", tx.split_name_list).alias("parsed"))
    names = tx.join_name_lists(F.col("parsed"))
    return parsed.select("doc_id", F.array_join(names, "|").alias("authors"))


@query(
    "authors_struct", "raw_docs", "SELECT doc_id, array_to_string(authors, '|') AS authors FROM raw_docs"
)
def authors_struct(t):
    parsed = t.raw_docs.select("doc_id", F.transform("authors", tx.split_name_struct).alias("parsed"))
    names = tx.join_name_structs(F.col("parsed"))
    return parsed.select("doc_id", F.array_join(names, "|").alias("authors"))


@query(
    "tag_source",
    "raw_docs",
    "SELECT source, count(*) AS papers FROM raw_docs GROUP BY source",
)
def tag_source(t):
    feeds = [
        t.raw_docs.where(F.col("source") == s).drop("source").withColumn("source", F.lit(s))
        for s in ("arxiv", "s2orc")
    ]
    return feeds[0].unionByName(feeds[1]).groupBy("source").agg(F.count(F.lit(1)).alias("papers"))


FLAT = "title, abstract, array_to_string(authors, '|') AS authors, year, source"


def flat(df, *extra):
    return df.select(
        *extra, "title", "abstract", F.array_join("authors", "|").alias("authors"), "year", "source"
    )


@query("union_feeds", "raw_docs", f"SELECT {FLAT} FROM raw_docs")
def union_feeds(t):
    arxiv = t.raw_papers.where("source = 'arxiv'")
    s2 = t.raw_papers.where("source = 's2orc'").withColumn("year", F.col("year").cast("bigint"))
    return flat(clean.union_feeds(arxiv, s2))


@query(
    "valid_papers",
    "raw_docs",
    f"""
SELECT {FLAT} FROM raw_docs WHERE abstract IS NOT NULL AND year IS NOT NULL AND len(authors) > 0""",
)
def valid_papers(t):
    return flat(clean.valid_papers(t.raw_papers))


@query(
    "rejected_papers",
    "raw_docs",
    f"""
SELECT {FLAT.replace("array_to_string(authors, '|') AS authors", "authors")}, 'failed_validation' AS reason
FROM (SELECT DISTINCT title, abstract, array_to_string(authors, '|') AS authors, year, source
      FROM raw_docs WHERE NOT (abstract IS NOT NULL AND year IS NOT NULL AND len(authors) > 0))""",
)
def rejected_papers(t):
    rejected = clean.rejected_papers(t.raw_papers)
    return flat(rejected, "reason")


@query(
    "final_layout", "papers", f"SELECT paper_id, {FLAT} FROM papers"
)
def final_layout(t):
    return flat(clean.final_layout(t.papers), "paper_id")


@query(
    "lower_text",
    "raw_docs",
    "SELECT doc_id, lower(title) AS title, lower(abstract) AS abstract FROM raw_docs",
)
def lower_text(t):
    return clean.normalise(t.raw_docs).select("doc_id", "title", "abstract")


@query(
    "paper_key",
    "raw_docs",
    "SELECT doc_id, sha256(lower(title) || CAST(year AS VARCHAR)) AS paper_id FROM raw_docs",
)
def paper_key(t):
    return clean.normalise(t.raw_docs).select("doc_id", "paper_id")


@query("dedup_papers", "papers", f"SELECT paper_id, {FLAT} FROM papers")
def dedup_papers(t):
    normal = clean.normalise(clean.valid_papers(t.raw_docs))
    return flat(clean.dedup_papers(normal, ["doc_id"]), "paper_id")


@query(
    "strip_ids",
    "hop1",
    f"SELECT trim(hop1_id, {BLANKS}) AS hop1_id, trim(hop0_id, {BLANKS}) AS hop0_id, seq FROM hop1",
)
def strip_ids(t):
    return clean.strip_ids(t.hop1, ["hop1_id", "hop0_id"]).select("hop1_id", "hop0_id", "seq")


HOP2_COLUMNS = "hop2_id, hop1_id, hop2_title, hop2_abstract, hop2_year, citation_text, seq"


@query("dedup_first", "clean2_all", f"SELECT {HOP2_COLUMNS} FROM clean2_all")
def dedup_first(t):
    return clean.keep_first(t.hop2, ["hop2_id", "hop1_id"], ["seq"])


@query("dedup_labelled", "clean1", "SELECT * FROM clean1")
def dedup_labelled(t):
    return clean.dedup_labelled(clean.strip_ids(t.hop1, ["hop1_id", "hop0_id"]), ["seq"])


@query("cross_layer_dedup", "clean2", f"SELECT {HOP2_COLUMNS} FROM clean2")
def cross_layer_dedup(t):
    return t.cleaned[2]


@query(
    "stage_counts",
    "clean0 clean2",
    """
SELECT 'hop0_raw' AS stage, count(*) AS rows FROM seeds_meta
UNION ALL SELECT 'hop1_raw', count(*) FROM hop1
UNION ALL SELECT 'hop2_raw', count(*) FROM hop2
UNION ALL SELECT 'hop0', count(*) FROM clean0
UNION ALL SELECT 'hop1', count(*) FROM clean1
UNION ALL SELECT 'hop2', count(*) FROM clean2
UNION ALL SELECT 'hop2_in_hop1', (SELECT count(*) FROM clean2_all) - (SELECT count(*) FROM clean2)""",
)
def stage_counts(t):
    h0, h1, h2 = t.cleaned
    within = clean.keep_first(clean.strip_ids(t.hop2, ["hop2_id", "hop1_id"]), ["hop2_id", "hop1_id"], ["seq"])
    dropped = within.join(
        h1.select(F.col("hop1_id").alias("hop2_id"), F.col("hop0_id").alias("hop1_id")),
        ["hop2_id", "hop1_id"],
        "left_semi",
    )
    return clean.stage_counts(
        hop0_raw=t.seeds_meta, hop1_raw=t.hop1, hop2_raw=t.hop2, hop0=h0, hop1=h1, hop2=h2,
        hop2_in_hop1=dropped,
    )


MEDIAN_SQL = """
  SELECT CAST(coalesce(trunc(median(year)), 2018) AS INTEGER) AS median_year
  FROM (SELECT year FROM clean0 UNION ALL SELECT hop1_year FROM clean1
        UNION ALL SELECT hop2_year FROM clean2)"""


def median_of(t):
    h0, h1, h2 = t.cleaned
    return clean.median_year(h0.select("year"), h1.select("hop1_year"), h2.select("hop2_year"))


@query("median_year", "clean0 clean2", MEDIAN_SQL)
def median_year(t):
    return median_of(t)


@query(
    "impute_missing",
    "clean0 clean2",
    f"""
, mid AS ({MEDIAN_SQL})
SELECT paper_id, coalesce(title, 'Unknown Title') AS title,
       coalesce(abstract, title, 'No abstract available') AS abstract,
       coalesce(year, (SELECT median_year FROM mid)) AS year
FROM nodes""",
)
def impute_missing(t):
    raw = t.nodes.select("paper_id", "title", "abstract", "year")
    return clean.impute_missing(raw, "abstract", "title", "year", median_of(t).scalar())


@query(
    "fill_context",
    "hop2",
    """
SELECT hop2_id, hop1_id, seq, coalesce(citation_text, 'Citation context missing.') AS citation_text
FROM hop2""",
)
def fill_context(t):
    return clean.fill_context(t.hop2.select("hop2_id", "hop1_id", "seq", "citation_text"))


# The first rescue answer for each ghost: what a part's own row holds, with gaps.
GHOSTS_SQL = """
  SELECT paper_id AS source_paper_id, coalesce(title, '') AS title,
         CASE WHEN p_size > 45 THEN ' ' ELSE coalesce(abstract, '') END AS abstract,
         CASE WHEN p_size < 40 THEN year END AS year, 's2_batch' AS source FROM nodes"""


def batch_rows(t):
    return t.nodes.select(
        F.col("paper_id").alias("source_paper_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.col("p_size") > 45, " ").otherwise(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        F.when(F.col("p_size") < 40, F.col("year")).alias("year"),
        F.lit("s2_batch").alias("source"),
    )


@query(
    "needs_rescue",
    "nodes",
    f"""
SELECT source_paper_id FROM ({GHOSTS_SQL}) WHERE trim(abstract) = '' OR year IS NULL""",
)
def needs_rescue(t):
    return clean.needs_rescue(batch_rows(t)).select("source_paper_id")


@query(
    "ghost_ids",
    "clean0 clean1",
    """
SELECT DISTINCT hop0_id AS source_paper_id FROM clean1
WHERE hop0_id NOT IN (SELECT source_paper_id FROM clean0)""",
)
def ghost_ids(t):
    return clean.ghost_ids(t.cleaned[0], t.cleaned[1])


# What each tier answers: single lookups know cheap parts, title searches the rest.
TIERS_SQL = {
    "s2": """
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS source_paper_id,
         CASE WHEN p_size < 24 THEN 's2 ' || p_name ELSE '' END AS abstract,
         CAST(CASE WHEN p_type <> 'SMALL' THEN 2001 END AS INTEGER) AS year
  FROM part WHERE p_brand <> 'Brand#3'""",
    "oa": """
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS source_paper_id,
         CASE WHEN p_size <> 46 THEN 'oa ' || p_name ELSE '' END AS abstract,
         CAST(CASE WHEN p_size > 30 THEN 2002 END AS INTEGER) AS year
  FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#4')""",
    "cr": """
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS source_paper_id,
         CASE WHEN p_type = 'PROMO' THEN '' ELSE 'cr ' || p_name END AS abstract,
         CAST(CASE WHEN p_type <> 'PROMO' THEN 2003 END AS INTEGER) AS year
  FROM part WHERE p_brand <> 'Brand#5'""",
}


def tier_tables(t):
    pid = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source_paper_id")
    name = F.col("p_name")

    def said(tag, cond):
        return F.when(cond, F.concat(F.lit(f"{tag} "), name)).otherwise("").alias("abstract")

    def year(y, cond):
        return F.when(cond, F.lit(y)).alias("year")

    size, kind, brand = F.col("p_size"), F.col("p_type"), F.col("p_brand")
    return {
        "s2_single": t.part.where(brand != "Brand#3").select(
            pid, said("s2", size < 24), year(2001, kind != "SMALL")
        ),
        "openalex": t.part.where(~brand.isin("Brand#3", "Brand#4")).select(
            pid, said("oa", size != 46), year(2002, size > 30)
        ),
        "crossref": t.part.where(brand != "Brand#5").select(
            pid, said("cr", kind != "PROMO"), year(2003, kind != "PROMO")
        ),
    }


FILLED_SQL = f"""
, g AS ({GHOSTS_SQL}), s2 AS ({TIERS_SQL['s2']}), oa AS ({TIERS_SQL['oa']}), cr AS ({TIERS_SQL['cr']}),
j AS (
  SELECT g.source_paper_id, g.title, g.source, g.abstract, g.title <> '' AS ht,
         nullif(trim(g.abstract), '') IS NULL AS na, g.year IS NULL AS ny,
         CASE WHEN trim(g.abstract) <> '' THEN g.abstract END AS a0, g.year AS y0,
         nullif(s2.abstract, '') AS a1, s2.year AS y1,
         CASE WHEN g.title <> '' THEN nullif(oa.abstract, '') END AS a2,
         CASE WHEN g.title <> '' THEN oa.year END AS y2,
         CASE WHEN g.title <> '' THEN nullif(cr.abstract, '') END AS a3,
         CASE WHEN g.title <> '' THEN cr.year END AS y3
  FROM g LEFT JOIN s2 USING (source_paper_id) LEFT JOIN oa USING (source_paper_id)
       LEFT JOIN cr USING (source_paper_id)),
filled AS (
SELECT source_paper_id, title, coalesce(a0, a1, a2, a3, abstract) AS abstract,
       coalesce(y0, y1, y2, y3) AS year,
       CASE WHEN NOT (na OR ny) THEN source
            WHEN coalesce(a0, a1) IS NOT NULL AND coalesce(y0, y1) IS NOT NULL THEN 's2_single'
            WHEN ht AND coalesce(a0, a1, a2) IS NOT NULL AND coalesce(y0, y1, y2) IS NOT NULL
              THEN 'openalex'
            WHEN ht AND (coalesce(a0, a1, a2, a3) IS NOT NULL OR coalesce(y0, y1, y2, y3) IS NOT NULL)
              THEN 'crossref' ELSE 'none' END AS source
FROM j)"""


@query("tiered_fill", "nodes", FILLED_SQL + "SELECT * FROM filled")
def tiered_fill(t):
    return clean.tiered_fill(batch_rows(t), tier_tables(t))


@query(
    "rescue_report",
    "nodes",
    FILLED_SQL
    + """
, x AS (SELECT unnest([{'item': 'total', 'hit': true},
                       {'item': 'with_abstract', 'hit': trim(abstract) <> ''},
                       {'item': 'with_year', 'hit': year IS NOT NULL},
                       {'item': 'via_' || source, 'hit': true}]) AS x FROM filled)
SELECT x.item AS item, count(*) FILTER (WHERE x.hit) AS count,
       round(count(*) FILTER (WHERE x.hit) * 100.0 / (SELECT count(*) FROM filled), 1) AS percent
FROM x GROUP BY 1""",
)
def rescue_report(t):
    return clean.rescue_report(clean.tiered_fill(batch_rows(t), tier_tables(t)))


@query(
    "merge_rescued",
    "clean0 nodes",
    FILLED_SQL
    + """
SELECT source_paper_id, title, abstract, year FROM clean0
UNION ALL
SELECT source_paper_id, title, abstract, year FROM filled
WHERE source_paper_id NOT IN (SELECT source_paper_id FROM clean0)""",
)
def merge_rescued(t):
    rescued = clean.tiered_fill(batch_rows(t), tier_tables(t)).drop("source")
    return clean.merge_rescued(t.cleaned[0], rescued)


# Author sources by brand: some papers are known to several, some to none.
AUTHOR_TIERS_SQL = """
, s2 AS (SELECT paper_id, author_id, author_id AS author_name, 'S2' AS source, 0 AS tier FROM writes
         WHERE starts_with(author_id, 'S')),
oa AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_id, 'oa_' || p_brand AS author_id,
              p_brand AS author_name, 'OpenAlex' AS source, 1 AS tier
       FROM part WHERE p_type <> 'PROMO'),
cr AS (SELECT 'P' || CAST(p_partkey AS VARCHAR), 'cr_' || p_name, p_name, 'CrossRef', 2
       FROM part WHERE p_size < 30),
a AS (SELECT * FROM s2 UNION ALL SELECT * FROM oa UNION ALL SELECT * FROM cr)"""


@query(
    "tiered_authors",
    "nodes writes",
    AUTHOR_TIERS_SQL
    + """
SELECT paper_id, author_id, author_name, source
FROM (SELECT *, min(tier) OVER (PARTITION BY paper_id) AS best FROM a) WHERE tier = best
UNION ALL
SELECT paper_id, 'final_unknown_' || paper_id || '_0', 'Unknown', 'Dummy_Gen'
FROM nodes WHERE paper_id NOT IN (SELECT paper_id FROM a)""",
)
def tiered_authors(t):
    pid = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("paper_id")
    tiers = {
        "S2": t.writes.where(F.col("author_id").startswith("S")).withColumn(
            "author_name", F.col("author_id")
        ),
        "OpenAlex": t.part.where("p_type <> 'PROMO'").select(
            pid, F.concat(F.lit("oa_"), "p_brand").alias("author_id"), F.col("p_brand").alias("author_name")
        ),
        "CrossRef": t.part.where("p_size < 30").select(
            pid, F.concat(F.lit("cr_"), "p_name").alias("author_id"), F.col("p_name").alias("author_name")
        ),
    }
    return clean.tiered_authors(t.nodes.select("paper_id"), tiers)


@query(
    "synth_author_ids",
    "writes",
    """
SELECT paper_id, CASE WHEN author_id IN ('LARGE', 'SMALL')
                 THEN 's2_unknown_' || paper_id || '_1' ELSE author_id END AS author_id
FROM writes""",
)
def synth_author_ids(t):
    listed = t.writes.select(
        "paper_id",
        F.when(F.col("author_id") == "SMALL", "")
        .when(F.col("author_id") != "LARGE", F.col("author_id"))
        .alias("author_id"),
        F.lit(1).alias("position"),
    )
    return clean.synth_author_ids(listed).select("paper_id", "author_id")


@query(
    "rebuild_abstract",
    "",
    """
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS abstract
FROM documents""",
)
def rebuild_abstract(t):
    return t.inverted.select("doc_id", tx.rebuild_text(F.col("inverted")).alias("abstract"))


@query(
    "strip_markup",
    "",
    r"""
SELECT page_id, array_to_string(list_transform(
    string_split_regex(
      regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                     '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
      '</?[a-zA-Z!?][^>]*>'),
    lambda p: trim(replace(replace(replace(replace(p, '&copy;', '©'), '&middot;', '·'),
                                   '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10))), '') AS content
FROM pages""",
)
def strip_markup(t):
    return t.pages.select("page_id", tx.strip_markup(F.col("html")).alias("content"))


@query(
    "issued_year",
    "nodes",
    "SELECT paper_id, CASE WHEN p_size <> 9 THEN year END AS year FROM nodes",
)
def issued_year(t):
    replies = pay.crossref_replies(t)
    return replies.select(
        "paper_id", tx.issued_year(F.get(F.col("reply.message.items"), F.lit(0))["issued"]).alias("year")
    )


@query(
    "referential_cascade",
    "clean0 clean2",
    """
, k1 AS (SELECT * FROM clean1 WHERE hop0_id IN (SELECT source_paper_id FROM clean0)),
k2 AS (SELECT * FROM clean2 WHERE hop1_id IN (SELECT hop1_id FROM k1))
SELECT 'hop1' AS layer, hop1_id AS citing_id, hop0_id AS cited_id FROM k1
UNION ALL SELECT 'hop2', hop2_id, hop1_id FROM k2""",
)
def referential_cascade(t):
    k1, k2 = clean.referential_cascade(*t.cleaned)
    return k1.select(
        F.lit("hop1").alias("layer"), F.col("hop1_id").alias("citing_id"), F.col("hop0_id").alias("cited_id")
    ).unionByName(
        k2.select(
            F.lit("hop2").alias("layer"), F.col("hop2_id").alias("citing_id"), F.col("hop1_id").alias("cited_id")
        )
    )


@query(
    "flag_to_float",
    "cites",
    """
SELECT citing_id, cited_id, CASE WHEN is_key AND context IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS is_key
FROM cites""",
)
def flag_to_float(t):
    flag = F.when(F.col("context").isNotNull(), F.col("is_key"))
    return t.cites.select("citing_id", "cited_id", clean.flag_to_float(flag).alias("is_key"))


@query(
    "present_search",
    "papers",
    """
SELECT replace(lower(title), 'ß', 'ss') AS title, array_to_string(authors, ', ') AS authors, year, upper(source) AS source,
       count(*) AS papers
FROM papers GROUP BY ALL""",
)
def present_search(t):
    shown = clean.present_search(t.papers)
    # capitals of ß are SS, so title case does not come back from lower case
    plain = F.replace(F.lower("title"), F.lit("ß"), F.lit("ss")).alias("title")
    return shown.groupBy(plain, "authors", "year", "source").agg(
        F.count(F.lit(1)).alias("papers")
    )


# Catalogue records: some titles as they are, some with the type behind them, some without their first word.
LEAST_SIMILARITY = 0.6


@query(
    "title_matches",
    "",
    f"""
WITH w AS (
  SELECT p_partkey AS k, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\pL\\pN]+'), lambda x: x <> '')) AS a,
         list_distinct(list_filter(regexp_split_to_array(lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type
           ELSE substr(p_name, strpos(p_name, ' ') + 1) END), '[^\\pL\\pN]+'), lambda x: x <> '')) AS b
  FROM part),
scored AS (
  SELECT x.k AS i, y.k AS j, len(list_intersect(x.a, y.b)) / (len(x.a) + len(y.b) - len(list_intersect(x.a, y.b))) AS s
  FROM (SELECT DISTINCT x.k AS i, y.k AS j FROM (SELECT k, unnest(a) AS t FROM w) x JOIN (SELECT k, unnest(b) AS t FROM w) y USING (t)) p
  JOIN w x ON x.k = p.i JOIN w y ON y.k = p.j)
SELECT 'P' || i AS paper_id, count(*) AS records, round(max(s), 6) AS best,
       'R' || arg_min(j, struct_pack(s := -s, j := 'R' || j)) AS record_id
FROM scored WHERE s >= {LEAST_SIMILARITY} GROUP BY i""",
)
def title_matches(t):
    """For each paper how many catalogue records have a similar title, and the best of them."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    other = (
        F.when(F.col("p_partkey") % 3 == 0, name)
        .when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", name, "p_type"))
        .otherwise(F.substr(name, F.instr(name, " ") + 1))
    )
    papers = titles.title_members(t.part.select(F.concat(F.lit("P"), key).alias("paper_id"), name.alias("title")), "paper_id")
    records = titles.title_members(t.part.select(F.concat(F.lit("R"), key).alias("record_id"), other.alias("title")), "record_id")
    left, right = (land(titles.title_classes(x, k), "title_classes") for x, k in ((papers, "paper_id"), (records, "record_id")))
    pairs = titles.match_titles(
        left.select(F.col("class").alias("paper_id"), F.col("class").alias("title")),
        right.select(F.col("class").alias("record_id"), F.col("class").alias("title")),
        LEAST_SIMILARITY,
    )
    # equal titles are matched once: no pair of two copies is made
    matches = titles.class_matches(pairs, papers, left, right)
    counts = matches.groupBy("paper_id").agg(F.sum("records").alias("records"))
    best = titles.best_matches(matches).withColumn("best", F.round("similarity", 6)).drop("similarity")
    return counts.join(best, "paper_id")
