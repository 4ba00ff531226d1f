"""Token counts of flat, unindexed token files.

A flat file is nothing but 16-bit little-endian numbers: 0 ends a document, any
other number is a token id plus one. There is no index, so documents are found by
searching for the ends. Files are cut into blocks of a set size; a task searches a
block at once and keeps where its ends lie. A prefix scan over a file's blocks gives
each block the tokens before it and the last end before it, which joins the pieces
of documents that cross blocks, over any number of blocks.

Defined results: a null or empty text is a document of 0 tokens. Numbers behind the
last end of a file, as a cut-off write leaves them, belong to no document. Empty
files and empty tables have no documents. Files are told apart by path. Repeated rows are
written and counted each. Very long texts cross as many blocks as they need. Only the text
is read, so ids may be null and further columns may have any names. A file is read by one
task and must stay below 2 GiB, the limit of Spark's binary files; `write` makes one a partition.
The last of 65,536 ids has no number of its own (65,535 plus one is 0): `write` refuses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.columns import pieces
from bibspark.llm.tokens import encoder

#: Numbers of a block.
BLOCK = 1 << 20
END = "\0\0"
#: The id that has no number of its own.
LAST = (1 << 16) - 1


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the texts of `docs` as flat token files, a file a partition, without a shuffle."""

    def run(batches):
        coder = encoder(tokenizer)
        for piece in pieces(batches, "text"):
            flat, bounds = coder.encode(piece["text"])
            if len(flat) and flat.max() == LAST:
                raise ValueError("the last of 65,536 ids would read as an end")
            buffers = [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(flat + np.uint16(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)], ["numbers"]
            )

    numbers = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "numbers binary")
    # a cast keeps the bytes as they are; the text writer puts an end behind each row
    numbers.select(F.col("numbers").cast("string")).write.option("lineSep", END).text(path)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, size, ends): where the ends lie in each block of each file below `path`."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                numbers = np.frombuffer(content.as_buffer(), "<u2", len(content.as_buffer()) // 2)
                for k in range(-(-len(numbers) // block)):
                    part = numbers[k * block : (k + 1) * block]
                    ends = np.flatnonzero(part == 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file]),
                            pa.array([k], pa.int64()),
                            pa.array([len(part)], pa.int64()),
                            pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64())),
                        ],
                        ["file", "block", "size", "ends"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, size long, ends array<long>")


def count(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document, from rows as `read_blocks` returns them."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns(
        {
            "base": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "ordinals": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        }
    )
    last_end = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    placed = placed.withColumn("last_end", last_end).withColumn(
        "begin", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0))
    )
    starts = F.concat(
        F.array(F.col("begin") - F.col("base")),
        F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda end: end + 1),
    )
    found = placed.where(F.size("ends") > 0).select(
        "file", "base", "ordinals", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end")))
    )
    return found.select(
        "file",
        (F.col("ordinals") + F.col("pos")).alias("ordinal"),
        (F.col("base") + F.col("col.start")).alias("start"),
        (F.col("col.end") - F.col("col.start")).alias("n_tokens"),
    )
