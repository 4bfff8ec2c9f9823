"""Heavy keys found by a sketch, and joins dealt by them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxline.operators.skew import heavy_keys, skew_join, small, trimmed


def test_trimming_keeps_the_bound():
    rng = random.Random(1)
    stream = ["a"] * 400 + ["b"] * 150 + [f"x{i}" for i in range(450)]
    rng.shuffle(stream)
    size, counts = 9, {}
    for i in range(0, len(stream), 50):
        for k, n in Counter(stream[i:i + 50]).items():
            counts[k] = counts.get(k, 0) + n
        counts = trimmed(counts, size)
    assert len(counts) <= size and counts["a"] >= 400 - 1000 / (size + 1) and counts["b"] >= 150 - 1000 / (size + 1)
    assert counts["a"] <= 400 and trimmed({}, 3) == {}


@pytest.mark.parametrize("parts", [1, 7, 90])
def test_no_heavy_key_is_missed(spark, parts):
    n = 20_000
    key = F.when(F.col("id") % 3 == 0, "third").when(F.col("id") % 50 == 1, "fiftieth").when(
        F.col("id") % 1000 == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    df = spark.range(n).repartition(parts).select(key.alias("k"))
    found = heavy_keys(df, F.col("k"), 0.02)
    true = {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert {"third"} <= set(found) and {k for k, c in true.items() if c >= 0.02 * n} <= set(found)
    assert all(true[k] - 0.01 * n <= c <= true[k] for k, c in found.items())
    assert heavy_keys(df.where("false"), F.col("k")) == {}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("a"), (F.col("id") % 2).alias("b"))
    left = left.unionByName(left.where("id < 40"))
    right = spark.createDataFrame([("hot", 0, "x"), ("hot", 0, "y"), ("k1", 1, "z"), (None, 1, "n"), ('q"/\\', 1, "odd")],
                                  "a string, b bigint, v string")
    want = sorted(map(tuple, left.join(right, ["a", "b"], how).collect()), key=repr)
    for rows in (0, 10_000):
        got = skew_join(left, right, ["a", "b"], how, broadcast_rows=rows)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    with pytest.raises(ValueError):
        skew_join(left, right, ["a"], "full")


def test_one_name_on_all_rows_spreads_evenly(spark):
    """The largest task has less than twice the rows of the median one."""
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        left = spark.range(200_000).select("id", F.lit("only").alias("name"))
        right = spark.createDataFrame([("only", 1), ("other", 2)], "name string, v int")
        out = skew_join(left, right, ["name"], broadcast_rows=0)
        tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(tasks) == 200_000 and len(tasks) == 16 and tasks[-1] < 2 * tasks[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_size_check(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert small(df, 100, 20_000) and not small(df, 99, 20_000) and not small(df, 100, 5_000)
    assert small(df.where("false"))
