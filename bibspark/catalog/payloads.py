"""API replies as JSON, derived from the driver tables, for the payload parsers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark import schemas


def inverted_docs(t) -> DataFrame:
    """(doc_id, inverted): word → positions of the whole text; blank words leave gaps.

    Built inside the row, without a shuffle: words are sorted with their positions, and each
    run of one word is an entry. A null text has a null map.
    """
    words = F.transform(
        F.split("text", " ", -1), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))
    )
    # texts stay in as many files as they were read from, which may be one: deal them anew by size
    docs = t.documents.select("doc_id", "text").hint("rebalance")
    spots = docs.select(
        "doc_id", F.sort_array(F.filter(words, lambda x: x["word"] != "")).alias("spots")
    )
    n, word = F.size("spots"), lambda k: F.get("spots", k - 1)["word"]
    every = F.when(n > 0, F.sequence(F.lit(1), n)).when(n == 0, F.array().cast("array<int>"))
    heads = spots.withColumn("heads", F.filter(every, lambda k: (k == 1) | (word(k) != word(k - 1))))
    ends = F.concat(F.slice("heads", 2, 1 << 30), F.array(n + 1))
    runs = F.arrays_zip(F.col("heads").alias("at"), F.slice(ends, 1, F.size("heads")).alias("end"))
    positions = F.transform(
        runs, lambda r: F.transform(F.slice("spots", r["at"], r["end"] - r["at"]), lambda x: x["pos"])
    )
    return heads.select("doc_id", F.map_from_arrays(F.transform("heads", word), positions).alias("inverted"))


def crossref_json(t) -> DataFrame:
    """(paper_id, payload): a first hit with date parts, abstract markup and one or two authors."""
    issued = F.struct(
        F.when((F.col("p_size") != 9) & F.col("year").isNotNull(), F.array(F.array("year")))
        .otherwise(F.array(F.array().cast("array<int>")))
        .alias("date-parts")
    )
    author = F.array(
        F.struct(
            F.when(
                F.col("p_type") == "PROMO", F.concat(F.lit("http://orcid.org/0000-"), "p_brand")
            ).alias("ORCID"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("given"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("family"),
        ),
        F.struct(
            F.lit(None).cast("string").alias("ORCID"),
            F.lit(None).cast("string").alias("given"),
            F.when(F.col("p_size") != 3, F.col("p_brand")).alias("family"),
        ),
    )
    item = F.struct(
        issued.alias("issued"),
        F.concat(F.lit("<jats:p>"), F.coalesce("abstract", F.lit("")), F.lit("</jats:p>")).alias("abstract"),
        author.alias("author"),
    )
    nodes = t.nodes.join(
        t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("paper_id"), "p_name"),
        "paper_id",
    )
    payload = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    return nodes.select("paper_id", payload.alias("payload"))


def crossref_replies(t) -> DataFrame:
    return crossref_json(t).select(
        "paper_id", F.from_json("payload", schemas.CROSSREF_REPLY).alias("reply")
    )


def openalex_json(t) -> DataFrame:
    """(paper_id, payload): a first hit with an inverted abstract and its authorships."""
    words = F.filter(F.split(F.coalesce("abstract", F.lit("")), " ", -1), lambda w: w != "")
    placed = F.transform(
        words, lambda w, i: F.struct(F.concat(w, F.lit("_"), i.cast("string")).alias("k"), F.array(i).alias("v"))
    )
    author = F.struct(
        F.when(F.col("p_type") != "SMALL", F.concat(F.lit("https://openalex.org/A"), F.col("p_size").cast("string")))
        .alias("id"),
        F.when(F.col("p_size") != 5, F.col("p_brand")).alias("display_name"),
    )
    item = F.struct(
        F.col("year").alias("publication_year"),
        F.map_from_entries(placed).alias("abstract_inverted_index"),
        F.array(F.struct(author.alias("author"))).alias("authorships"),
    )
    results = F.when(F.col("p_type") == "LARGE", F.array().cast(
        "array<struct<publication_year:int,abstract_inverted_index:map<string,array<int>>,"
        "authorships:array<struct<author:struct<id:string,display_name:string>>>>>"
    )).otherwise(F.array(item))
    return t.nodes.select("paper_id", F.to_json(F.struct(results.alias("results"))).alias("payload"))


def citation_json(t) -> DataFrame:
    """(hop1_id, payload): the citations of each cited part, one reply per citing part."""
    vec = t.nodes.select(F.col("paper_id").alias("citing_id"), "title", "abstract", "year", "p_brand", "p_type")
    rows = t.cites.select("citing_id", "cited_id", "context").join(vec, "citing_id")
    contexts: Column = F.when(F.col("context").isNotNull(), F.array("context", F.lit("second"))).otherwise(
        F.array().cast("array<string>")
    )
    citing = F.struct(
        F.when(F.col("p_type") != "PROMO", F.col("citing_id")).alias("paperId"),
        "title",
        "year",
        "abstract",
        F.array(
            F.struct(F.col("p_brand").alias("authorId")),
            F.struct(F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("authorId")),
        ).alias("authors"),
    )
    edge = F.struct(contexts.alias("contexts"), citing.alias("citingPaper"))
    missing = F.struct(contexts.alias("contexts"), F.lit(None).cast(
        "struct<paperId:string,title:string,year:int,abstract:string,authors:array<struct<authorId:string>>>"
    ).alias("citingPaper"))
    return rows.select(
        F.col("cited_id").alias("hop1_id"),
        F.to_json(F.struct(F.array(edge, missing).alias("data"))).alias("payload"),
    )
