"""API replies landed as JSON text, flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.functions import text as tx
from bibspark.skew import keep_first


def _citation_edges(replies: DataFrame, payload: str):
    parsed = replies.select("hop1_id", F.from_json(payload, schemas.CITATION_REPLY).alias("reply"))
    edges = parsed.select("hop1_id", F.explode("reply.data").alias("e"))
    return edges.where(F.coalesce("e.citingPaper.paperId", F.lit("")) != "")


def flatten_citations(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per citing paper with an id: first context, author ids as a JSON list."""
    ids = F.filter(
        F.transform(F.coalesce("e.citingPaper.authors", F.array()), lambda a: a["authorId"]),
        lambda i: i.isNotNull() & (i != ""),
    )
    return _citation_edges(replies, payload).select(
        F.col("hop1_id").cast("string").alias("hop1_paper_id"),
        F.col("e.citingPaper.paperId").alias("hop2_paper_id"),
        F.col("e.citingPaper.title").alias("hop2_title"),
        F.col("e.citingPaper.year").alias("hop2_year"),
        F.col("e.citingPaper.abstract").alias("hop2_abstract"),
        F.to_json(ids).alias("hop2_author_ids"),
        F.get("e.contexts", F.lit(0)).alias("citation_context"),
    )


def flatten_citations_strict(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Only edges with a context and an abstract."""
    return flatten_citations(replies, payload).where(
        "citation_context is not null and hop2_abstract is not null and hop2_abstract <> ''"
    )


def consolidate_chunks(chunks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (hop1, hop2) pair over all landed chunks."""
    return keep_first(chunks, ["hop1_paper_id", "hop2_paper_id"], order)


def flatten_authors(replies: DataFrame, ids: str = "ids", payload: str = "payload") -> DataFrame:
    """(paper_id, position, author_id, author_name) of batch replies.

    A reply answers its request by position: entry i is about id i, and may be null.
    """
    zipped = replies.select(
        F.explode(
            F.arrays_zip(
                F.col(ids).alias("paper_id"),
                F.from_json(payload, schemas.AUTHOR_REPLY).alias("reply"),
            )
        ).alias("z")
    )
    return zipped.select(
        F.col("z.paper_id").alias("paper_id"), F.posexplode("z.reply.authors").alias("position", "a")
    ).select(
        "paper_id",
        "position",
        F.col("a.authorId").alias("author_id"),
        F.coalesce("a.name", F.lit("Unknown")).alias("author_name"),
    )


def batch_metadata(
    replies: DataFrame, payload: str = "payload", default_year: int | None = None
) -> DataFrame:
    """(paper_id, title, year, abstract, authors) of the non-null entries of batch replies."""
    rows = replies.select(
        F.explode(F.from_json(payload, schemas.METADATA_REPLY)).alias("m")
    ).where("m is not null and m.paperId is not null")
    year = F.col("m.year")
    return rows.select(
        F.col("m.paperId").alias("paper_id"),
        F.col("m.title").alias("title"),
        (year if default_year is None else F.coalesce(year, F.lit(default_year))).alias("year"),
        F.col("m.abstract").alias("abstract"),
        F.coalesce("m.authors", F.array()).alias("authors"),
    )


def _openalex_hit(replies: DataFrame, payload: str) -> DataFrame:
    reply = F.from_json(payload, schemas.OPENALEX_REPLY)
    return replies.select("paper_id", F.get(reply["results"], F.lit(0)).alias("hit")).where(
        "hit is not null"
    )


def _crossref_hit(replies: DataFrame, payload: str) -> DataFrame:
    reply = F.from_json(payload, schemas.CROSSREF_REPLY)
    return replies.select("paper_id", F.get(reply["message"]["items"], F.lit(0)).alias("hit")).where(
        "hit is not null"
    )


def first_hit_openalex(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """(paper_id, author_id, author_name) of the first hit; authors without id are dropped."""
    rows = _openalex_hit(replies, payload).select(
        "paper_id", F.explode("hit.authorships").alias("a")
    )
    return rows.where(F.coalesce("a.author.id", F.lit("")) != "").select(
        "paper_id",
        F.concat(F.lit("oa_"), F.element_at(F.split("a.author.id", "/", -1), -1)).alias("author_id"),
        F.coalesce("a.author.display_name", F.lit("Unknown")).alias("author_name"),
    )


def first_hit_crossref(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """The same of a first hit that names authors by ORCID, or not at all."""
    rows = _crossref_hit(replies, payload).select(
        "paper_id", F.posexplode("hit.author").alias("position", "a")
    )
    full = tx.strip_blanks(F.concat_ws(" ", F.coalesce("a.given", F.lit("")), F.coalesce("a.family", F.lit(""))))
    name = F.coalesce(F.when(full != "", full), F.lit("Unknown"))
    orcid = F.concat(F.lit("cr_"), F.replace("a.ORCID", F.lit("http://orcid.org/"), F.lit("")))
    made = F.concat_ws(
        "_", F.lit("cr"), F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.col("position").cast("string")
    )
    return rows.select(
        "paper_id",
        F.when(F.coalesce("a.ORCID", F.lit("")) != "", orcid).otherwise(made).alias("author_id"),
        name.alias("author_name"),
    )


def openalex_abstracts(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """(source_paper_id, abstract, year) of the first hit."""
    return _openalex_hit(replies, payload).select(
        F.col("paper_id").alias("source_paper_id"),
        F.coalesce(tx.rebuild_text(F.col("hit.abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.col("hit.publication_year").alias("year"),
    )


def crossref_abstracts(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """The same of a first hit whose abstract carries markup."""
    return _crossref_hit(replies, payload).select(
        F.col("paper_id").alias("source_paper_id"),
        F.coalesce(tx.strip_markup(F.col("hit.abstract")), F.lit("")).alias("abstract"),
        tx.issued_year(F.col("hit.issued")).alias("year"),
    )
