"""The corpus pipeline: documents in, token files out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Its
result is written as Parquet and read again as the next one's docs, so a lost executor
costs at most the stage at hand. All stages but the last return the columns of documents.
The mix repeats documents, so doc_ids may recur in the token files.

Defined results: a null text counts as an empty one; empty texts are scored, grouped and
mixed like any other, and as they have no words the mix takes none of them. Rows without doc_id go through
all stages: they are grouped by their texts with all others, and stand first in the token files.
Repeated rows, equal or not, are judged each by the classifier; of rows with linked
fingerprints one stays. Very long texts are worked on whole at every stage. Ties: of a group the row with the
smallest doc_id stays, of equal ones the one with the smaller text hash. Empty documents give no rows;
without labels every score is 0.5 and all documents stay; without benchmark items none is
contaminated. Further columns are handed on until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibspark.llm import decontaminate, mixing, quality, simhash, token_files
from bibspark.llm.queries import MIX_SHARE, MIX_WEIGHTS, table, tokenizer_file
from bibspark.session import land, new_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id if any has one, of each group of linked fingerprints."""
    return simhash.keep_one(docs, nameless=True)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled over."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: no, one or two rows each."""
    return mixing.repeat(docs, MIX_WEIGHTS, MIX_SHARE)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, from the token files written for all of them."""
    path = new_path(spark, "pipeline-tokens")
    token_files.write(docs, path, tokenizer_file())
    return token_files.digest(token_files.read(spark, path))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", single_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token_files", token_rows),
]

#: The stages hash and classify in ways SQL does not have; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
