"""Mixing sources to target weights by Pareto order sampling, in SQL functions only.

Each source has a target number of words. Every document first gets the certain whole
copies, as many as fit the source's rate (target over size), and the rest of the rate is
the probability p of one copy more. For that, documents get a random number u from a hash
of their id (of more than the id where a source has it twice) and are ranked by the ratio of odds u/(1-u) : p/(1-p); the source's ranks
are taken in order until the words left over are used up. An optional column scales
the probabilities of documents within a source, which makes them unequal there too;
Pareto ranks keep each document's chance close to its p although the size is fixed.
What is then missing is less than the next document in rank. One document per source, the
one whose size comes closest to what is missing, is added if that is an improvement.

No source is ranked in one task: ranks fall into cells, the words of the cells are summed,
and only the cell in which the target falls is cut again, LEVELS times. Sources are
numbered by a range sort with an offset per partition. Sums over cells see CELLS rows
a source.

Defined results: a null text has size 0; null sources form one source, numbered last.
Documents of size 0 are taken as often as their rate says in words, that is 0. Rows of one
source that share a doc_id are ranked each for itself: their u comes from the id, a hash of
their text (and scale) and their number among the rows alike in these. Which of such rows
has which number is open, as they are interchangeable. A missing doc_id is an empty id, shared
or not like any other. A source of size 0 has target 0. An empty table gives no rows. A very
long text is a row like any other: it is taken whole or not at all, so a target smaller than
such a text is met only to within its size. Only doc_id, text and source (and the scaling
column) are read; `repeat` hands on all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.columns import WORD
from bibspark.session import land

#: A document's words are taken at most so often.
MOST_COPIES = 2
#: Cells a level and levels; a last cell holds about the CELLS ** -LEVELS part of a source.
CELLS, LEVELS = 1024, 3
#: Hash digits behind u.
DIGITS = 13


def sized(docs: DataFrame, scale: str | None = None) -> DataFrame:
    """(doc_id, source, size, hash, scale, number, u): words, random number and unique key of each document.

    Within a source, doc_id, hash and number name one row.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    scaling = F.lit(1.0) if scale is None else F.col(scale).cast("double")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        text_hash(scaling).alias("hash"),
        scaling.alias("scale"),
        F.spark_partition_id().alias("at"),
    )
    rows = land(rows, "words")
    shared = rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = land(shared.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source")), "shared-ids")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    alone = rows.join(shared, same, "left_anti").drop("at")
    alone = alone.withColumns({"number": F.lit(0).cast("long"), "u": uniform(name)})
    again = numbered(rows.join(shared, same, "left_semi"), ["doc_id", "source", "hash"]).drop("at")
    further = F.concat_ws("/", name, F.col("hash").cast("string"), F.col("number").cast("string"))
    return alone.unionByName(again.withColumn("u", uniform(further)))


def text_hash(scaling: Column | None = None) -> Column:
    """A hash of a row's text and scale."""
    return F.xxhash64(F.col("text").cast("string"), F.lit(1.0) if scaling is None else scaling)


def numbered(rows: DataFrame, alike: list[str]) -> DataFrame:
    """Landed `rows` with their `number`, from 0, among those alike; `at` is the partition that wrote each.

    A task gets no more rows that are alike than one partition wrote.
    """
    counts = rows.groupBy(*alike, "at").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*alike).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(c).alias(f"_{c}") for c in [*alike, "at"]], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n")
    )
    inside = Window.partitionBy(*alike, "at").orderBy("at")
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    same = F.col("at") == F.col("_at")
    for c in alike:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    number = (F.col("_n") + F.col("_place")).cast("long").alias("number")
    return placed.join(before, same).select(*rows.columns, number)


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 that a hash of `key` fixes."""
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**DIGITS)


def targets(sizes: DataFrame, weights: list[float], share: float, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take `weights` in turn. Together they get
    `share` times all words; no target exceeds `most` times its source, and the excess
    is shared again by weight among the others until none does.
    """
    sums = land(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ordered = sums.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    placed = land(
        ordered.withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id"),
        "source-order",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition of the sort
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    turn = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("_offset") + F.col("_place"), F.lit(len(weights))) + 1).cast("int"),
    )
    weighed = land(
        placed.join(offsets, "_part").select("source", "source_size", turn.alias("weight")), "source-weights"
    )
    limit = most * F.col("source_size")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).scalar()
    whole = weighed.select((share * total).cast("double").alias("x")).limit(1).collect()
    left, heavy, rate = (whole[0]["x"] if whole else 0.0), None, None
    while True:
        # sources at their limit keep it; what is left is shared by the weights of the others
        full = F.lit(False) if rate is None else F.col("weight") * rate >= limit
        free, held, capped = weighed.agg(
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(full, limit.cast("double"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).collect()[0]
        if capped == heavy or not free:
            break
        heavy, rate = capped, (left - held) / free
    of_weight = F.col("weight") * (0.0 if rate is None else rate)
    target = F.when(full, limit.cast("double")).otherwise(F.least(of_weight, limit.cast("double")))
    return weighed.select("source", "source_size", target.alias("target"))


def _of_source(rows: DataFrame, lookup: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `lookup` for their source, a null source matching a null one."""
    named = lookup.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def sample(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash, source_size, target, copies) from `sized` rows and `targets` rows."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    certain = F.floor(rate)
    p = F.least(F.greatest((rate - certain) * F.col("scale"), F.lit(0.0)), F.lit(1.0))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    joined = (
        _of_source(sizes, aims)
        .withColumns({"certain": certain.cast("int"), "p": p})
        # ranks keep the order of the odds ratio and lie between 0 and 1
        .withColumn("rank", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0))
        .drop("u", "scale")
    )
    rows = land(joined, "ranked")
    missing = rows.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("missing")
    )
    missing = land(missing.select("source", "missing", F.lit(0.0).alias("low"), F.lit(1.0).alias("width")), "missing")
    for _ in range(LEVELS):
        # the cell in which the missing words run out, cut again at the next level
        inside = (
            _of_source(rows.where("p > 0"), missing).where("rank >= low and rank < low + width")
        )
        cell = F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * CELLS), F.lit(CELLS - 1)).cast("int")
        words = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("cell")
        summed = words.withColumn("up_to", F.sum("words").over(up_to))  # at most CELLS rows a source
        after = _of_source(missing, summed, "left")
        fits = F.col("up_to") <= F.col("missing")
        cut = after.groupBy("source").agg(
            F.first("missing").alias("all"),
            F.first("low").alias("low"),
            F.first("width").alias("width"),
            F.coalesce(F.max(F.when(fits, F.col("up_to"))), F.lit(0)).alias("used"),
            F.min(F.when(~fits, F.col("cell"))).alias("cell"),
        )
        narrow = F.col("width") / CELLS
        missing = land(
            cut.select(
                "source",
                (F.col("all") - F.col("used")).alias("missing"),
                # nothing runs out: everything fits, and the cut lies at the end
                F.when(F.col("cell").isNull(), F.col("low") + F.col("width"))
                .otherwise(F.col("low") + F.col("cell") * narrow)
                .alias("low"),
                F.when(F.col("cell").isNull(), F.lit(0.0)).otherwise(narrow).alias("width"),
            ),
            "missing",
        )
    taken = _of_source(rows, missing)
    first = (F.col("p") > 0) & (F.col("rank") < F.col("low"))
    closest = (
        taken.where(~first & F.expr("certain < 2 and size > 0 and abs(missing - size) < abs(missing)"))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("missing") - F.col("size")), "rank", "doc_id", "hash", "number")).alias("x"))
        .select("source", *[F.col(f"x.{c}").alias(f"last_{c}") for c in ("doc_id", "hash", "number")])
    )
    out = _of_source(taken, closest, "left")
    last = F.col("doc_id").eqNullSafe(F.col("last_doc_id")) & ~first
    last &= (F.col("hash") == F.col("last_hash")) & (F.col("number") == F.col("last_number"))
    return out.select(
        "doc_id",
        "source",
        "size",
        "hash",
        "source_size",
        "target",
        (F.col("certain") + (first | F.coalesce(last, F.lit(False))).cast("int")).alias("copies"),
    )


def mix(sizes: DataFrame, weights: list[float], share: float) -> DataFrame:
    """`sample` of `sized` rows towards `targets` of these weights and share."""
    sizes = land(sizes, "sizes")
    return sample(sizes, targets(sizes, weights, share))


def repeat(docs: DataFrame, weights: list[float], share: float) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them.

    Of rows alike in doc_id, source and text, as many get one copy more as the mix says, whichever they are.
    """
    mixed = mix(sized(docs), weights, share)
    alike = ["doc_id", "source", "hash"]
    often = mixed.groupBy(*alike).agg(
        F.min("copies").alias("_copies"), F.sum(F.col("copies")).alias("_all"), F.count(F.lit(1)).alias("_rows")
    )
    of = land(
        often.where("_all > 0").select(
            *[F.col(k).alias(f"_{k}") for k in alike],
            "_copies",
            (F.col("_all") - F.col("_copies") * F.col("_rows")).alias("_more"),
        ),
        "copies",
    )
    doc = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text_hash().alias("hash"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    same &= F.col("hash") == F.col("_hash")
    copies = doc.join(of.where("_more = 0"), same).select("doc", "_copies")
    # rows alike that are not all taken equally often are numbered
    uneven = land(of.where("_more > 0"), "uneven-copies")
    if uneven.limit(1).count():
        some = land(doc.join(uneven, same).withColumn("at", F.spark_partition_id()), "uneven-rows")
        more = (F.col("number") < F.col("_more")).cast("int")
        copies = copies.union(numbered(some.drop(*[f"_{k}" for k in alike]), alike).select("doc", F.col("_copies") + more))
    out = copies.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("doc.*")
