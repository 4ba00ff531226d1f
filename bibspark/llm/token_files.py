"""Token ids of documents as Parquet list columns, and reading them back selectively.

The files hold one row per document in ascending doc_id order: `part` and `before`
(place of the file and ids before the row in it), `doc_id`, `n_tokens`, and `ids`,
the token ids with the end id appended. Ids are dictionary-coded (a vocabulary is
smaller than a dictionary page), the other columns delta-coded; row groups and
pages have set sizes, and Spark's writer adds the page indexes, so that reading
counts skips the ids and reading one document's ids skips the other pages.

A file's place in the whole is not known while it is written. Files number their
own rows; a reader adds up the files' totals (one row a file) to place them.

Defined results: a null or empty text has only the end id. Rows without doc_id come
first. Rows that share a doc_id stand side by side, ordered by their texts' hashes.
An empty table gives files without rows. Repeated rows are written each. Very long texts are
encoded whole and make one list each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.columns import documents_of, pieces
from bibspark.llm.tokens import encoder

SCHEMA = "part int, before long, doc_id long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
#: Bytes of text that are cut into parts at once.
PARTS_BYTES = 2 << 20
#: Rows that go to a worker at once while files are written: texts are long.
ROWS_AT_ONCE = 500


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """SCHEMA rows of `docs` (doc_id, text), one range of doc_ids a partition, in order."""

    def run(batches):
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text", PARTS_BYTES):
            flat, bounds = coder.encode(piece["text"])
            sizes = np.diff(bounds) + 1
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.full(offsets[-1], end_id, np.int32)
            inside = np.ones(len(ids), bool)
            inside[offsets[1:] - 1] = False
            ids[inside] = flat
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(before + offsets[:-1]),
                    piece["doc_id"],
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                ],
                ["part", "before", "doc_id", "n_tokens", "ids"],
            )
            before += int(offsets[-1])
            pa.default_memory_pool().release_unused()

    order = ["doc_id", F.xxhash64("text")]
    return documents_of(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode `docs` and write them below `path`."""
    writer = encode(docs, tokenizer, end_id).write.option("compression", "zstd")
    for key, value in {
        "parquet.compression.codec.zstd.level": 1,
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }.items():
        writer = writer.option(key, str(value))
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(ROWS_AT_ONCE))
    try:
        writer.parquet(path)
    finally:
        conf.set(key, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files below `path`; unread columns are not decoded."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one small row a file, however many documents: that is all the window and the broadcast see
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(places), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as `read` returns them."""

    def run(batches):
        for batch in batches:
            lists = batch["ids"]
            flat = lists.flatten().to_numpy(zero_copy_only=False).view("<u4")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(flat[e - n : e].data) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
