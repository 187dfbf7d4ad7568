"""Skew-safe ordering primitives against plain window functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import sigframe.operators.ordering as O


def _hot(spark):
    # key 1 holds most rows (a hot group spread over several range partitions)
    data = [(1, i, float((i * 7) % 13)) for i in range(200)] + [(k, i, float(i)) for k in (2, 3) for i in range(5)]
    return spark.createDataFrame(data, "k long, ts long, x double")


def test_dense_index_matches_row_number(spark):
    df = _hot(spark)
    got = O.dense_index(df, ["k"], ["ts"], partitions=6)
    ref = df.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1)
    assert sorted(map(tuple, got.select("k", "ts", "t").collect())) == sorted(map(tuple, ref.select("k", "ts", "t").collect()))


def test_dense_index_without_keys_is_global_rank(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "v long")
    got = sorted(map(tuple, O.dense_index(df, [], ["v"], out="r").collect()))
    assert got == [(1, 0), (3, 1), (5, 2), (9, 3)]


def test_blocked_lags_equal_plain_window(spark):
    df = O.dense_index(_hot(spark), ["k"], ["ts"])
    b = O.blocked(df, halo=3, block=8)
    w = O.block_window(["k"])
    got = b.select("k", "t", F.lag("x", 3).over(w).alias("l3"), F.lead("x", 2).over(w).alias("f2"), O.HALO)
    got = got.filter(~F.col(O.HALO)).select("k", "t", "l3", "f2")
    pw = Window.partitionBy("k").orderBy("t")
    ref = df.select("k", "t", F.lag("x", 3).over(pw).alias("l3"), F.lead("x", 2).over(pw).alias("f2"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_block_carry_running_sum(spark):
    df = O.dense_index(_hot(spark), ["k"], ["ts"])
    b = O.blocked(df, block=16)
    run = b.withColumn("_run", F.sum("x").over(O.block_window(["k"]).rowsBetween(Window.unboundedPreceding, 0)))
    carry = O.block_carry(run, ["k"], {"_c": ("sum", F.col("x"))})
    got = run.join(carry, ["k", O.BLK], "left").select("k", "t", (F.col("_run") + F.coalesce("_c", F.lit(0.0))).alias("s"))
    ref = df.select("k", "t", F.sum("x").over(Window.partitionBy("k").orderBy("t")).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_top_k_per_group_salted(spark):
    df = _hot(spark)
    got = O.top_k_per_group(df, ["k"], [F.col("x").desc(), F.col("ts")], 4, salt_buckets=8)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("x").desc(), "ts")))
    ref = ref.filter("rank <= 4")
    assert sorted(map(tuple, got.select("k", "ts", "rank").collect())) == sorted(
        map(tuple, ref.select("k", "ts", "rank").collect()))
