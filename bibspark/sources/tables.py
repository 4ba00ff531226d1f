"""Readers and writers of the landed tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark import schemas
from bibspark.sources.feeds import first_existing

INDEX_SCHEMAS = {
    "papers": schemas.PAPERS,
    "author_stats": schemas.AUTHOR_STATS,
    "temporal_topics": schemas.TEMPORAL_TOPICS,
    "collaborations": schemas.COLLABORATIONS,
    "rejected_papers": schemas.REJECTED,
}
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def load_indexes(spark: SparkSession, base: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The index tables below `base` with their declared schemas."""
    found, missing = {}, []
    for name in names or INDEX_SCHEMAS:
        try:
            found[name] = spark.read.schema(INDEX_SCHEMAS[name]).parquet(f"{base}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"no index {missing} below {base}: build the index first")
    return found


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header.

    With `multi_line`, quoted fields may span lines, and each file is read by one task, as a
    line break does not tell where a record ends: land such data as many files. Without
    it, files are split by size like any other.
    """
    return spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower()).schema(schema).csv(path)


def _in_file_order(df: DataFrame) -> DataFrame:
    """Adds `seq`, which grows along each file: a split's first byte plus the row's place in it.

    A row has at least one byte, so a split's rows stay before those of the next one.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select("*", (F.col("_metadata.file_block_start") + place).alias("seq"))


def _with_flag(spark: SparkSession, path: str, schema: str, flag: str = "isKeyCitation") -> str:
    """`schema` in the order of the file's header, with the flag where the header has it."""
    types = dict(x.strip().split(" ", 1) for x in schema.split(",")) | {flag: "boolean"}
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    return ", ".join(f"{c} {types[c]}" for c in header) if flag in header else schema


def scan_hops(
    spark: SparkSession, base: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seed, first and second layer, each with its order `seq`; the rescued seed table (`_v2`) is preferred.

    The files' names are fixed values. The first layer has `isKeyCitation` if its header does. `multi_line=False` reads files
    without line breaks inside fields in splits.
    """
    hop0 = first_existing(
        spark, f"{base}/hop0_metadata_final_v2.csv", f"{base}/hop0_metadata_final.csv"
    )
    hop1 = f"{base}/hop1_final_dataset_rescued.csv"
    return (
        _in_file_order(read_csv(spark, hop0, schemas.HOP0, multi_line)),
        _in_file_order(read_csv(spark, hop1, _with_flag(spark, hop1, schemas.HOP1), multi_line)),
        _in_file_order(read_csv(spark, f"{base}/hop2_final_dataset.csv", schemas.HOP2, multi_line)),
    )


def scan_citations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CITATIONS).json(path)


def write_partitioned(
    df: DataFrame,
    path: str,
    by: str = "year",
    sort: list[str] | None = None,
    mode: str = "overwrite",
    only_present: bool = False,
) -> None:
    """Parquet folders per value of `by`.

    Rebalancing groups a value's rows into few files and lets adaptive execution
    split a value that holds too much for one task. Rows are sorted inside files
    by `sort`, so equality filters skip row groups. Overwriting replaces the whole
    table, or with `only_present` just the values that occur in `df`.
    """
    out = df.hint("rebalance", by)
    if sort:
        out = out.sortWithinPartitions(by, *sort)
    scope = "dynamic" if only_present else "static"
    out.write.mode(mode).option("partitionOverwriteMode", scope).partitionBy(by).parquet(path)


def write_plain(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
