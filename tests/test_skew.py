"""Splitting hot keys changes where rows are joined, never what comes out."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.skew import find_hot, keep_first, spread_join


@pytest.fixture
def tiny_tasks(spark):
    spark.conf.set("bibspark.rowsPerTask", "3")
    yield
    spark.conf.unset("bibspark.rowsPerTask")


def facts_of(spark):
    """Key 1 holds most rows; key 9 has no lookup row; one key is null."""
    return spark.range(100).select(
        F.when(F.col("id") < 70, 1).when(F.col("id") < 80, 9).when(F.col("id") < 99, F.col("id") % 5 + 2)
        .cast("int").alias("k"), F.col("id").alias("v"))


def lookup_of(spark):
    return spark.createDataFrame([(i, f"name{i}") for i in range(0, 8)], "k int, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, rows, tiny_tasks, how):
    facts, lookup = facts_of(spark), lookup_of(spark)
    cols = ["k", "v"] if how in ("left_semi", "left_anti") else ["k", "v", "name"]
    wanted = rows(facts.join(lookup, "k", how), *cols)
    assert rows(spread_join(facts, lookup, "k", how), *cols) == wanted
    assert rows(spread_join(facts, lookup, "k", how, hot=find_hot(facts, "k")), *cols) == wanted


def test_counts_held_by_the_lookup(spark, rows, tiny_tasks):
    facts = facts_of(spark).na.drop()
    lookup = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = spread_join(facts, lookup, "k", rows="n")
    assert rows(got, "k", "v", "n", "top") == rows(facts.join(lookup, "k"), "k", "v", "n", "top")


def test_no_task_gets_more_than_its_share(spark):
    """A key of a fifth of the rows, and a thousand times more rows than one task may join."""
    limit = 40
    settings = {"bibspark.rowsPerTask": str(limit), "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4000",
                "spark.sql.adaptive.skewJoin.enabled": "false"}
    facts = spark.range(1000 * limit).select(F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(1000 * limit).select(F.col("id").alias("k")).union(spark.range(1).select(F.lit(-1).cast("long")))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = spread_join(facts, lookup, "k")
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in parts) == 1000 * limit
        assert max(r.n for r in parts) <= 2 * limit
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_without_hot_keys_the_join_is_plain(spark):
    facts, lookup = facts_of(spark), lookup_of(spark)
    plan = spread_join(facts, lookup, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" not in plan and plan.count("Range") == 1


def test_hot_key_is_split(spark, tiny_tasks):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_join(facts_of(spark), lookup_of(spark), "k").where("k = 1")
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(parts) > 4 and sum(r.n for r in parts) == 70
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.sampled_from([None, "x", "y"])),
                min_size=1, max_size=12))
def test_keep_first_is_the_least_row(spark, data):
    df = spark.createDataFrame(data, "k string, o int, v string")
    got = {r.k: (r.o, r.v) for r in keep_first(df, ["k"], ["o"]).collect()}
    for k in {d[0] for d in data}:
        mine = [(o, v is not None, v or "") for kk, o, v in data if kk == k]
        best = min(mine)
        assert got[k] == (best[0], best[2] if best[1] else None)


def test_keep_first_ignores_row_order(spark, rows):
    data = [(i % 7, i * 37 % 11, f"t{i}") for i in range(200)]
    a = spark.createDataFrame(data, "k int, o int, v string")
    b = spark.createDataFrame(data[::-1], "k int, o int, v string").repartition(5)
    assert rows(keep_first(a, ["k"], ["o"])) == rows(keep_first(b, ["k"], ["o"]))


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    plan = keep_first(spark.range(10).selectExpr("id % 2 k", "id v"), ["k"])._jdf.queryExecution().toString()
    assert "partial_min" in plan


def test_keys_are_counted_only_in_crowded_cells(spark, tiny_tasks):
    """No key is counted, and none landed, where no cell of hashes has more rows than a task may join."""
    from bibspark import skew

    few = spark.range(3).select(F.col("id").alias("k"), F.col("id").alias("v"))
    counted, plain = [], skew.key_counts
    skew.key_counts = lambda df, keys: counted.append(df.count()) or plain(df, keys)
    try:
        assert skew._hot_counts(few, ["k"], 3) is None and find_hot(few, "k", "v") == {"k": None, "v": None}
        assert counted == []
        hot = {r.k: r._n for r in skew._hot_counts(facts_of(spark), ["k"], 5).collect()}
    finally:
        skew.key_counts = plain
    want = {r.k: r["count"] for r in facts_of(spark).groupBy("k").count().where("count > 5").collect()}
    assert hot == want and counted[0] < 100


def test_the_largest_part_of_an_order_comes_with_one_exchange(spark):
    from bibspark.catalog.bindings import with_lead

    data = [(1, 5), (1, 9), (1, 9), (1, None), (2, None), (2, None), (None, 7), (None, 8), (3, 4)]
    data += [(4, i) for i in range(60)]
    want = []
    for order, part in data:
        if order is not None:
            want.append((order, part, max((p for o, p in data if o == order and p is not None), default=None)))
    lines = spark.createDataFrame(data, "l_orderkey bigint, l_partkey bigint").repartition(3)
    led = with_lead(lines)
    assert sorted(map(tuple, led.select("l_orderkey", "l_partkey", "lead").collect()), key=repr) == sorted(want, key=repr)
    assert led._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(l_orderkey") == 1
    spark.conf.set("bibspark.rowsPerTask", "20")
    try:
        dealt = with_lead(lines).select("l_orderkey", "l_partkey", "lead").collect()
    finally:
        spark.conf.unset("bibspark.rowsPerTask")
    assert sorted(map(tuple, dealt), key=repr) == sorted(want, key=repr)
