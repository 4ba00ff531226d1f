"""Centroid clustering with SQL functions only: integer k-means over literal centroids.

Vectors become whole numbers once, floor(scale * x) of every component, and are written. A
round is one scan: ``zip_with`` and ``aggregate`` give the squared distance to each row of a
literal array of centroids, ``array_min`` over structs (distance, number) takes the nearest,
and one sum column per component, combined on the map side, gives the new centroids. The
driver holds the centroids and gets, each round, one row of sums per cluster, never a vector.
All arithmetic is exact, so the result depends neither on the order of rows nor on the
number of tasks.

Which vectors start is set by a hash of their ids, so reruns agree. A cluster without
vectors keeps its centroid.

Defined results: a vector that is null, has another length, or holds a null or non-finite
component takes no part and has no row. Components beyond 2^27 / scale (524,288 at a scale of
256) count as that bound, so that no distance exceeds a long. A row without vec_id is
clustered like any other; when starting vectors are chosen it stands behind all rows with an
id. Repeated rows count each; of equal hashes, the smaller vector starts first. With fewer
vectors than clusters every vector starts one. Of equally near centroids the smaller number
wins. A sum of distances beyond a long is null. Empty tables give no rows; further columns
are ignored, whatever their names. There are no texts here, so none is empty or long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.session import land

#: The contract's figures.
CLUSTERS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
#: Whole numbers stay within this, so that SIZE squared differences fit a long.
BOUND = 1 << 27


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): the vectors that take part as arrays of whole numbers, and their squared lengths."""
    e = F.col("e")
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(
        e, lambda x: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), x * scale)))
    )
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
        .where((F.size(e) == size) & sound)
        .select("vec_id", whole.alias("v"))
        .select("vec_id", "v", F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x * x).alias("norm"))
    )


def first_centroids(points: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in that order; `clusters` rows at most."""
    rank = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(rank.asc_nulls_last(), F.col("v")).limit(clusters)
    return [r.v for r in first.select("v").collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """struct(excess, cluster) of the centroid nearest to v; the squared distance is excess + |v|^2.

    |v - c|^2 = |v|^2 + |c|^2 - 2 vc, so a centroid's constant holds |c|^2 and the components of -2c.
    """
    rows = [f"struct({sum(x * x for x in c)}L AS b, array({', '.join(f'{-2 * x}L' for x in c)}) AS w)" for c in centroids]

    def excess(c: Column) -> Column:
        return F.aggregate(F.zip_with("v", c["w"], lambda x, y: x * y), c["b"], lambda total, x: total + x)

    return F.array_min(
        F.transform(
            F.expr(f"array({', '.join(rows)})"), lambda c, k: F.struct(excess(c).alias("excess"), k.alias("cluster"))
        )
    )


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floored means of their vectors."""
    size = len(centroids[0])
    near = points.select("v", nearest(centroids)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)]
    )
    out = list(centroids)
    for row in sums.collect():  # one row per cluster
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(size)]
    return out


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE
) -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, cluster, distance), one row per vector that takes part, and the
    clusters that have any: (cluster, n_vectors, cluster_inertia, centroid)."""
    points = land(whole_vectors(vectors, size, scale), "whole-vectors")
    centroids = first_centroids(points, clusters)
    if not centroids:
        found = points.select("vec_id", F.lit(0).alias("cluster"), F.col("norm").alias("distance"))
        centre = F.lit(None).cast("array<bigint>")
    else:
        for _ in range(rounds):
            centroids = moved(points, centroids)
        near = points.select("vec_id", "norm", nearest(centroids).alias("near"))
        distance = (F.col("near.excess") + F.col("norm")).alias("distance")
        found = land(near.select("vec_id", "near.cluster", distance), "nearest-centroids")
        rows = ", ".join(f"array({', '.join(f'{x}L' for x in c)})" for c in centroids)
        centre = F.get(F.expr(f"array({rows})"), F.col("cluster"))
    by_cluster = found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.try_sum("distance").alias("cluster_inertia")
    )
    return found, by_cluster.withColumn("centroid", centre)


def with_inertia(found: DataFrame, by_cluster: DataFrame) -> DataFrame:
    """Assignments with their cluster's inertia and centroid hash, and the inertia of all."""
    total = by_cluster.agg(F.try_sum("cluster_inertia")).scalar()
    summary = by_cluster.select(
        "cluster", "cluster_inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    )
    # one row per cluster: bounded by the parameter
    return found.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256"
    )
