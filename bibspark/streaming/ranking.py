"""Author rankings kept up to date: new citations change what they reach, and nothing else is read.

A citation changes the score of the paper it cites; that changes a value among those that count
for the papers the cited one cites itself, and their indexes, their authors' values, and
those authors' ranks. Everything of the state is kept by key, in folders by bucket of the key:

* citations by citing paper, author rows by paper, as they came;
* scores and indexes of papers and ranks of authors, the latest of each key counting;
* how many values of a paper or an author have which whole value, as additions that may be
  negative: a changed value takes one from its old whole value and adds one to its new.

A batch reads the buckets of its own keys in the batches before it, and writes its changes as
its own. A batch that runs again writes the same anew. What a batch took away
is exactly what an earlier one added, as old values are read from the state and not summed up again.
A key that many rows share is dealt over tasks where rows are joined (`spread_join`).

Citations without one of their ids are dropped; repeated ones count again, as in the full run; a
citation without weight weighs nothing. Authors and their papers are given at the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators import metrics
from bibspark.session import land
from bibspark.skew import spread_join

BUCKETS = 64

#: Table: (key, other columns). The two tables of counts are sums; `scores`, `indexes` and `ranks` hold latest values.
STATE = {
    "citations": ("citing_id", "cited_id string, weight double"),
    "author_rows": ("paper_id", "author_id string, a_i bigint"),
    "scores": ("paper_id", "s_c double, raw bigint"),
    "paper_counts": ("paper_id", "m string, v bigint, n bigint"),
    "indexes": ("paper_id", "h_p double, sh_p double"),
    "author_counts": ("author_id", "m string, v bigint, n bigint"),
    "ranks": ("author_id", "normal_hp_frac double, semantic_hp_frac double, total_papers bigint"),
}
EDGES = "citing_id string, cited_id string, semantic_weight double"
NORMAL, SEMANTIC = "normal_hp_frac", "semantic_hp_frac"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, out: str, table: str) -> DataFrame:
    key, rest = STATE[table]
    return spark.read.schema(f"{key} string, {rest}, batch bigint, bucket int").parquet(f"{out}/{table}")


def _write(rows: DataFrame, out: str, table: str, batch: int, buckets: int) -> None:
    key, _ = STATE[table]
    placed = rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{out}/{table}/batch={batch}"
    )


class _Step:
    """A batch at work on the state."""

    def __init__(self, spark: SparkSession, out: str, batch: int, buckets: int):
        self.spark, self.out, self.batch, self.buckets = spark, out, batch, buckets

    def before(self, table: str, keys: DataFrame) -> DataFrame:
        """The table as of the batches before, from the folders alone that the keys (landed) fall in."""
        key, _ = STATE[table]
        opened = keys.select(_bucket(key, self.buckets).alias("b")).distinct().collect()
        rows = _read(self.spark, self.out, table).where(F.col("batch") < self.batch)
        return rows.where(F.col("bucket").isin([r.b for r in opened]))

    def latest(self, table: str, keys: DataFrame) -> DataFrame:
        key, _ = STATE[table]
        return _latest(self.before(table, keys).join(keys.select(key), key, "left_semi"), table)

    def add_counts(self, table: str, changes: DataFrame) -> DataFrame:
        """Writes changes of counts; returns all counts of the keys that have some, partitioned by key."""
        key, _ = STATE[table]
        same = changes.groupBy(key, "m", "v").agg(F.sum("n").alias("n")).where("n <> 0")
        _write(same, self.out, table, self.batch, self.buckets)
        # what is written is read back: the state holds it, no second copy is needed
        new = _read(self.spark, self.out, table).where(F.col("batch") == self.batch).select(key, "m", "v", "n")
        keys = new.select(key).distinct()
        old = self.before(table, keys).join(keys, key, "left_semi").select(key, "m", "v", "n")
        # one exchange by key serves the sums here and the indexes made of them
        every = old.unionByName(new).repartition(key)
        return every.groupBy(key, "m", "v").agg(F.sum("n").alias("n")).where("n > 0")


def _latest(rows: DataFrame, table: str) -> DataFrame:
    key, _ = STATE[table]
    rest = [c for c in rows.columns if c not in (key, "batch", "bucket")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def _changes(rows: DataFrame, key: str, values: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """(key, m, v, n): one less for each old value, one more for each new one, where they differ."""
    parts = []
    for name, (old, new) in values.items():
        now = metrics.whole(new)
        moves = [(now, 1)] if old is None else [(metrics.whole(old), -1), (now, 1)]
        for v, n in moves:
            part = F.struct(F.lit(name).alias("m"), v.alias("v"), F.lit(n).cast("bigint").alias("n"))
            # a value that stays the same whole number would be taken away and added again
            parts.append(part if old is None else F.when(~metrics.whole(old).eqNullSafe(now), part))
    moved = rows.select(key, F.explode(F.array(*parts)).alias("x")).where("x is not null")
    return moved.select(key, "x.m", "x.v", "x.n")


def start(writes: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """A state without citations for the author rows (author_id, paper_id)."""
    spark = writes.sparkSession
    listed = writes.select("author_id", "paper_id").na.drop()
    rows = spread_join(listed, metrics.coauthor_count(listed), "paper_id", rows="a_i")
    _write(rows, out, "author_rows", 0, buckets)
    none = {NORMAL: (None, F.lit(0)), SEMANTIC: (None, F.lit(0))}
    zeros = _changes(listed, "author_id", none).groupBy("author_id", "m", "v").agg(F.sum("n").alias("n"))
    _write(zeros, out, "author_counts", 0, buckets)
    for table, (key, rest) in STATE.items():
        if table not in ("author_rows", "author_counts"):
            _write(spark.createDataFrame([], f"{key} string, {rest}"), out, table, 0, buckets)


def add_citations(edges: DataFrame, out: str, batch: int, buckets: int = BUCKETS) -> None:
    """Adds weighted citations (citing_id, cited_id, semantic_weight) as batch number `batch`, from 1 on."""
    if batch < 1:
        raise ValueError("batches are numbered from 1")
    step = _Step(edges.sparkSession, out, batch, buckets)
    given = edges.select("citing_id", "cited_id", F.coalesce("semantic_weight", F.lit(0.0)).alias("weight"))
    _write(given.na.drop(), out, "citations", batch, buckets)
    new = _read(step.spark, out, "citations").where(F.col("batch") == batch).drop("batch", "bucket")

    # scores of the papers cited now, before and after
    more = new.groupBy(F.col("cited_id").alias("paper_id")).agg(
        F.sum("weight").alias("more"), F.count(F.lit(1)).alias("n")
    )
    more = land(more, "more_cited")
    was = step.latest("scores", more)
    scored = land(
        more.join(was, "paper_id", "left").select(
            "paper_id",
            F.coalesce("s_c", F.lit(0.0)).alias("old_s"),
            F.coalesce("raw", F.lit(0)).alias("old_raw"),
            (F.coalesce("s_c", F.lit(0.0)) + F.col("more")).alias("s_c"),
            (F.coalesce("raw", F.lit(0)) + F.col("n")).alias("raw"),
        ),
        "scored",
    )
    _write(scored.select("paper_id", "s_c", "raw"), out, "scores", batch, buckets)

    # values of the papers that those cite: moved by earlier citations, added by new ones
    changed = scored.withColumnRenamed("paper_id", "citing_id")
    earlier = step.before("citations", changed).select("citing_id", "cited_id")
    moved = _changes(
        spread_join(earlier, changed, "citing_id").withColumnRenamed("cited_id", "paper_id"),
        "paper_id",
        {"h_p": (F.col("old_raw"), F.col("raw")), "sh_p": (F.col("old_s"), F.col("s_c"))},
    )
    citing = land(new.select(F.col("citing_id").alias("paper_id")).distinct(), "citing")
    known = step.latest("scores", citing).join(scored, "paper_id", "left_anti")
    known = known.unionByName(scored.select("paper_id", "s_c", "raw")).withColumnRenamed("paper_id", "citing_id")
    placed = spread_join(new.select("citing_id", "cited_id"), known, "citing_id", "left")
    added = _changes(
        placed.withColumnRenamed("cited_id", "paper_id"),
        "paper_id",
        {"h_p": (None, F.coalesce("raw", F.lit(0))), "sh_p": (None, F.coalesce("s_c", F.lit(0.0)))},
    )
    counts = step.add_counts("paper_counts", moved.unionByName(added))

    # indexes that have changed
    now = land(metrics.hirsch_of_counts(counts, "paper_id", ["h_p", "sh_p"], placed=True), "indexes")
    was = step.latest("indexes", now).withColumnsRenamed({"h_p": "old_h", "sh_p": "old_sh"})
    zero = F.lit(0.0)
    both = now.join(was, "paper_id", "left").select(
        "paper_id", F.coalesce("old_h", zero).alias("old_h"), F.coalesce("old_sh", zero).alias("old_sh"), "h_p", "sh_p"
    )
    rose = land(both.where("old_h <> h_p or old_sh <> sh_p"), "changed_indexes")
    _write(rose.select("paper_id", "h_p", "sh_p"), out, "indexes", batch, buckets)

    # their authors' values and ranks
    authors = step.before("author_rows", rose).select("author_id", "paper_id", "a_i")
    values = spread_join(authors, rose, "paper_id")
    a = F.col("a_i")
    counts = step.add_counts(
        "author_counts",
        _changes(
            values,
            "author_id",
            {NORMAL: (F.col("old_h") / a, F.col("h_p") / a), SEMANTIC: (F.col("old_sh") / a, F.col("sh_p") / a)},
        ),
    )
    ranks = metrics.hirsch_of_counts(counts, "author_id", [NORMAL, SEMANTIC], count_as="total_papers", placed=True)
    _write(ranks, out, "ranks", batch, buckets)


def ranking(spark: SparkSession, out: str) -> DataFrame:
    """The author ranking as of all batches so far, as `metrics.hp_frac` gives it."""
    ranks = _latest(_read(spark, out, "ranks"), "ranks").where(F.col(NORMAL) > 0)
    shift = (F.col(SEMANTIC) - F.col(NORMAL)).alias("impact_shift")
    return ranks.select("author_id", NORMAL, SEMANTIC, "total_papers", shift)


def compact(spark: SparkSession, out: str, to: str, buckets: int = BUCKETS) -> None:
    """The same state without its history, as batch 0 of the folder `to`; batches go on there."""
    for table, (key, _) in STATE.items():
        rows = _read(spark, out, table)
        if table in ("scores", "indexes", "ranks"):
            rows = _latest(rows, table)
        elif table in ("paper_counts", "author_counts"):
            rows = rows.groupBy(key, "m", "v").agg(F.sum("n").alias("n")).where("n <> 0")
        else:
            rows = rows.drop("batch", "bucket")
        _write(rows, to, table, 0, buckets)


def follow(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 200) -> None:
    """Adds the weighted citations of all landed JSON files not seen before to a started state, then stops."""
    edges = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_per_batch).json(landing)
    (
        edges.writeStream.foreachBatch(lambda rows, number: add_citations(rows, out, number + 1))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
