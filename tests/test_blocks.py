import random

import numpy as np
from pyspark.sql import Window as W, functions as F

from spectrafold.operators import blocks, ranks


def _series(spark, n=300, hot=200):
    rng = random.Random(1)
    rows = [("hot" if i < hot else f"s{i % 3}", rng.randrange(40) / 4, i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double, id long")


def test_ranged_index_equals_row_number(spark):
    df = _series(spark)
    plain = df.withColumn("pos", F.row_number().over(W.partitionBy("g").orderBy("v", "id")) - 1)
    ranged = blocks.ranged_index(df, ["g"], ["v", "id"], "pos")
    assert {(r.g, r.id, r.pos) for r in plain.collect()} == {(r.g, r.id, r.pos) for r in ranged.collect()}


def test_blocked_windows_equal_plain_windows(spark):
    df = blocks.dense_index(_series(spark), ["g"], ["id"], "pos")
    order = W.partitionBy("g").orderBy("pos")
    want = df.select(
        "g", "pos", F.lag("v").over(order).alias("a"), F.avg("v").over(order.rowsBetween(-5, -1)).alias("m"),
        F.sum("v").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
        F.max("v").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("x"),
    )
    got = blocks.halo_window(df, ["g"], "pos", lambda w: {"a": F.lag("v").over(w), "m": F.avg("v").over(w.rowsBetween(-5, -1))}, 5, 0, block=16)
    got = blocks.running_sum(got, ["g"], "pos", {"s": "v"}, block=7)
    got = blocks.running_sum(got, ["g"], "pos", {"x": "v"}, block=7, largest=True).select("g", "pos", "a", "m", "s", "x")
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


def test_distributed_quantiles_and_ranks(spark):
    df = _series(spark)
    spread = {r.g: (r.q, r.m) for r in ranks.quantiles(df, ["g"], "v", {"q": 0.1, "m": 0.5}).collect()}
    inside = {r.g: (r.q, r.m) for r in ranks.quantiles(df, ["g"], "v", {"q": 0.1, "m": 0.5}, bounded=True).collect()}
    assert spread.keys() == inside.keys() and all(np.allclose(spread[g], inside[g]) for g in spread)
    hot = np.array([r.v for r in df.where("g = 'hot'").collect()])
    assert np.allclose(spread["hot"], np.quantile(hot, [0.1, 0.5]))
    spread = {r.id: r.rank for r in ranks.average_ranks(df, ["g"], "v", "rank").collect()}
    inside = {r.id: r.rank for r in ranks.average_ranks(df, ["g"], "v", "rank", bounded=True).collect()}
    assert spread == inside


def test_numbers_of_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 5), (None, 3), ("a", 9)], "g string, id int")
    assert {(r.g, r.id, r.pos) for r in blocks.dense_index(df, ["g"], ["id"], "pos").collect()} == {(None, 3, 0), (None, 5, 1), ("a", 9, 0)}


def test_join_stats_reaches_every_row(spark):
    df = blocks.dense_index(_series(spark), ["g"], ["id"], "pos")
    stats = df.groupBy("g").agg(F.avg("v").alias("m"), F.max("pos").alias("_last"))
    assert blocks.join_stats(df, ["g"], "pos", stats, block=16).count() == 300
    assert blocks.join_spread(df, ["g"], stats.drop("_last"), "id", salts=5).count() == 300
