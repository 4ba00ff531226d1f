"""Nearest neighbours by randomly rotated one-bit codes with error bounds, and exact reranking.

A vector, less the centre, is scaled to length one and turned by a random rotation; the
signs of its coordinates are its code, one bit a dimension. With the code go its norm and
a correction scalar, the inner product of the unit vector with its own code. For a
query, the inner product with the code divided by the correction estimates the inner
product with the vector, and its error is bounded, with a probability set by
`BOUND`, by sqrt((1 - correction^2) / correction^2) * BOUND / sqrt(d - 1) times the
query's length. A block of vectors is searched as a whole: the k-th smallest upper bound of a
query's distances says which rows cannot be among its nearest, all others are reranked
by their exact distance in double precision.

Rows are packed into blocks of BLOCK vectors, queries into blocks of QUERIES. Each block of
queries meets each block of vectors once, and hands on its k best; the best of all blocks
are then merged. The centre and the rotation come from a bounded sample of at most `SAMPLE`
rows and a seed; every row is indexed. A code costs an eighth of a byte a dimension; the
original vectors travel with their block and are only read for reranking.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, neither do those of another length than the most frequent one (of equally
frequent ones the longest), nor rows without an id. Every row is a candidate and, if its id
says so, a query of its own: rows that share an id, equal ones too, are each found, each find the
others, and each have ranks of their own. Ties in distance go to the smaller id. Where
there are fewer than k candidates, all are returned. No queries or an empty table: no rows.
Further columns are ignored, whatever their names. There are no texts here, so none is empty or long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.session import land

BLOCK, QUERIES, SAMPLE, SEED = 16_384, 1_024, 4_096, 17
#: Standard deviations of the estimate that the bound allows for.
BOUND = 5.0
#: Distances of a query block and a vector block held at once.
AT_ONCE = 1 << 20


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(row, vec_id, vec): numbered rows, without those that take no part. Numbers hold once they are written."""
    vec = F.col(vector).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vec"), bad.alias("bad"))
        .where("vec_id is not null and vec is not null and not bad")
        .where(F.exists("vec", lambda x: x != 0))
        .withColumn("dim", F.size("vec"))
    )
    # one row a length: how many lengths occur, not how many rows
    common = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1)
    fitting = good.join(F.broadcast(common.select("dim")), "dim")
    return fitting.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of `dim` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, norms and correction scalars of the rows of `vectors`."""
    shifted = vectors - centre
    norms = np.sqrt((shifted**2).sum(axis=1))
    turned = (shifted / np.where(norms > 0, norms, 1)[:, None]) @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), norms, np.where(norms > 0, own, 1.0)


def _search(queries: np.ndarray, query_rows, vectors: np.ndarray, rows, ids, coded, centre, turn, k):
    """For each query its k best of the block, its own row left out: query places, row places, distances."""
    bits, norms, own = coded
    d = vectors.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    spread = np.sqrt(np.maximum(1 - own**2, 0)) / own * (BOUND / np.sqrt(max(1, d - 1)))
    some = max(1, AT_ONCE // len(vectors))
    for low in range(0, len(queries), some):
        q = queries[low : low + some]
        shifted = q - centre
        length = np.sqrt((shifted**2).sum(axis=1))
        inner = ((shifted @ turn).astype(np.float32) @ signs.T) / np.sqrt(d) / own
        square = length[:, None] ** 2 + norms**2 - 2 * norms * inner
        error = 2 * norms * spread * length[:, None] + 1e-5 * (1 + square.max())
        other = query_rows[low : low + some][:, None] != rows[None, :]
        upper = np.where(other, square + error, np.inf)
        last = min(k, len(ids)) - 1
        limit = np.partition(upper, last, axis=1)[:, last]
        at, row = np.nonzero(other & (square - error <= limit[:, None]))
        distance = np.sqrt(((q[at] - vectors[row]) ** 2).sum(axis=1))
        order = np.lexsort((ids[row], distance, at))
        at, row, distance = at[order], row[order], distance[order]
        first = np.searchsorted(at, np.arange(len(q)))
        keep = np.arange(len(at)) - first[at] < k
        yield at[keep] + low, row[keep], distance[keep]


def nearest(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row that `is_query` (of vec_id) picks."""
    found = land(usable(rows, vector), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    # a hash order gives the same sample at every run
    sample = found.where(F.pmod(F.xxhash64("vec_id"), F.lit(64)) == 0).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        sample = found.limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    centre = np.array(sample["vec"].to_pylist(), float).mean(axis=0)
    turn = rotation(len(centre))

    def matrix(batch) -> np.ndarray:
        flat = batch["vec"].flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(flat.reshape(batch.num_rows, -1))

    def pack(limit):
        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, limit):
                    some = batch.slice(low, limit)
                    vectors, ids = matrix(some).astype("<f4" if single else "<f8"), some["vec_id"].to_numpy()
                    rows = some["row"].to_numpy()
                    columns = [rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), vectors.tobytes()]
                    if limit == BLOCK:
                        bits, norms, own = code(vectors.astype(float), centre, turn)
                        columns += [bits.tobytes(), norms.tobytes(), own.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names[: len(columns)])

        return run

    single = found.schema["vec"].dataType.elementType.typeName() == "float"
    names = ["rows", "ids", "vectors", "bits", "norms", "own"]
    blocks = land(
        found.mapInArrow(pack(BLOCK), ", ".join(f"{n} binary" for n in names)).withColumn(
            "block", F.monotonically_increasing_id()
        ),
        "code-blocks",
    )
    asked = found.where(is_query).mapInArrow(pack(QUERIES), "rows binary, ids binary, vectors binary")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors")])
    # every block of queries goes to every cell of vector blocks; cells, not rows, are listed
    cells = max(1, blocks.count())
    blocks = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    met = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).join(blocks, "cell")

    def search(batches):
        kind = "<f4" if single else "<f8"
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], kind).reshape(len(ids), -1).astype(float)
                q_rows, q_ids = (np.frombuffer(row[c], "<i8") for c in ("q_rows", "q_ids"))
                queries = np.frombuffer(row["q_vectors"], kind).reshape(len(q_ids), -1).astype(float)
                coded = (
                    np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1),
                    np.frombuffer(row["norms"]),
                    np.frombuffer(row["own"]),
                )
                rows = np.frombuffer(row["rows"], "<i8")
                for at, hit, distance in _search(queries, q_rows, vectors, rows, ids, coded, centre, turn, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(ids[hit]), pa.array(distance)],
                        ["query_row", "query_id", "vec_id", "score"],
                    )

    best = met.select("q_rows", "q_ids", "q_vectors", *names).mapInArrow(
        search, "query_row long, query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
