"""Joins and keep-first aggregation that stay even when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.session import land

# A key with more rows than this is hot, whatever the size of the table.
ROWS_PER_TASK = 1_000_000
# Rows with a null key match nothing; where they must stay they are dealt over so many slots.
NULL_SLOTS = 1024
# Cells of key hashes that are counted before keys are.
CELLS = 1 << 16


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("bibspark.rowsPerTask", str(ROWS_PER_TASK)))


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n): rows per key, combined on the map side."""
    return df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _slots(limit: int) -> Column:
    # slots of half a task: two that meet by chance still make no more than one task's rows
    return F.ceil(F.col("_n") * 2 / F.lit(limit)).cast("int").alias("_slots")


def _crowded(df: DataFrame, keys: list[list[str]], limit: int) -> dict[int, list[int]]:
    """For each set of key columns, by its number, the cells with more than `limit` rows.

    A cell holds all rows of its keys, so a key outside these cells is not hot. Cells are
    whole numbers and few: each task hands on at most `CELLS` rows for a set, not one a key. At most
    total / limit numbers of a set reach the driver.
    """
    cell = [F.struct(F.lit(i).alias("_set"), _cell(k).alias("_cell")) for i, k in enumerate(keys)]
    counts = df.select(F.explode(F.array(*cell)).alias("x")).groupBy("x._set", "x._cell").agg(F.count(F.lit(1)).alias("_n"))
    found = {i: [] for i in range(len(keys))}
    for r in counts.where(F.col("_n") > limit).collect():
        found[r["_set"]].append(r["_cell"])
    return found


def _cell(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")


def _hot_counts(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """(keys, _n) of the keys with more than `limit` rows, None if no key can have them."""
    crowded = _crowded(df, [keys], limit)[0]
    if not crowded:
        return None
    return key_counts(df.where(_cell(keys).isin(crowded)), keys).where(F.col("_n") > limit)


def find_hot(df: DataFrame, *keys: str) -> dict[str, DataFrame | None]:
    """For each key column its hot keys as (key, _slots), None if it has none; one pass for all columns.

    The columns must have one type. The result serves every join of a chain that starts
    from `df` and adds no rows. Keys are counted only in cells of hashes that are crowded.
    """
    limit = rows_per_task(df)
    crowded = _crowded(df, [[k] for k in keys], limit)
    if not any(crowded.values()):
        return dict.fromkeys(keys)
    ends = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("_end"), F.col(k).alias("_key"), _cell([k]).isin(crowded[i]).alias("_in"))
                for i, k in enumerate(keys)
            ]
        )
    )
    counts = df.select(ends.alias("x")).where("x._in").groupBy("x._end", "x._key").agg(F.count(F.lit(1)).alias("_n"))
    hot = land(counts.where(F.col("_n") > limit).select("_end", "_key", _slots(limit)), "hot_keys")
    found = {r["_end"] for r in hot.select("_end").distinct().collect()}
    return {
        k: hot.where(F.col("_end") == i).select(F.col("_key").alias(k), "_slots") if i in found else None
        for i, k in enumerate(keys)
    }


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "inner",
    rows: str | None = None,
    hot: dict[str, DataFrame | None] | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join `facts` to `lookup` without piling a hot key on one task.

    Keys are counted first, in cells of hashes, and one by one only in a crowded cell. If none has more than `bibspark.rowsPerTask` rows, the join is
    the one Spark plans, with nothing added. Otherwise the rows of a hot key are dealt
    over slots by their number, so that equal rows part as well, the lookup rows of hot
    keys are repeated once for each slot, and key and slot together are the key of one
    shuffled join. Only (key, slots) of hot keys is broadcast: at most
    total / rowsPerTask narrow rows. A lookup with several rows per key repeats all of them.

    The facts occur once in the plan, and once in the count before it. `rows` names a lookup
    column that already holds the fact rows per key (the lookup is landed, and not counted);
    `sizes` are such counts as (keys, _n); `hot` is what `find_hot` found for a chain.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if hot is not None:
        hot_rows = hot[keys[0]]
    else:
        limit = rows_per_task(facts)
        if rows is not None:
            lookup = land(lookup, "counted_lookup")
            sizes = lookup.select(*keys, F.col(rows).alias("_n"))
        hot = _hot_counts(facts, keys, limit) if sizes is None else sizes.where(F.col("_n") > limit)
        hot_rows = None
        if hot is not None:
            found = hot.select(*keys, _slots(limit))
            # counts in a landed lookup are read again at no cost; others are counted once
            found = found if rows is not None else land(found, "hot_keys")
            hot_rows = None if found.isEmpty() else found
    if hot_rows is None:
        return facts.join(lookup, keys, how)
    hot_rows = F.broadcast(hot_rows)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    number = F.monotonically_increasing_id()
    dealt = facts.join(hot_rows, keys, "left").withColumn(
        "_slot",
        F.when(no_key, F.pmod(number, F.lit(NULL_SLOTS)))
        .otherwise(F.pmod(number, F.coalesce("_slots", F.lit(1))))
        .cast("int"),
    )
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)).alias("_slot")
    repeated = lookup.join(hot_rows, keys, "left").select(*lookup.columns, every)
    return dealt.drop("_slots").join(repeated, [*keys, "_slot"], how).drop("_slot")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """One row per key: the least by `order`, then by the remaining columns.

    A plain ``min`` of a struct, so every map task already reduces a hot key to
    one row before the shuffle, and the choice does not depend on row order.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in (order or [])]
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(
        *[c.alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(f"`{c}`") for c in rest]
    )
    best = df.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest]).select(*df.columns)
