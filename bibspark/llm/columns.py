"""Small helpers shared by the operators: Arrow columns, number arrays, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; longer texts form a piece of their own.
PIECE_BYTES = 4 << 20
#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one piece have about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(
            [0 if not v.is_valid else len(v.as_buffer()) for v in batch.column(column)], dtype=np.int64
        )
        ends = np.cumsum(sizes)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, ends[stop - 1]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(column)]


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`fn(batch)` -> record batch or None, over the pieces' batches of every partition."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone: whatever else a table holds cannot clash with an operator's columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
