"""The driver tables seen as canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spectrafold.sources.tables import edge_table, series_from_arrays, table


def embedding_series(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, label, pos, value): one series per embedding."""
    return series_from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", ["label"])


def images(spark: SparkSession, d: str) -> DataFrame:
    """16 x 16 images: four consecutive embeddings hold four rows of pixels each."""
    return embedding_series(spark, d).select(
        F.expr("series_id div 4").alias("img_id"),
        ((F.col("series_id") % 4) * 4 + F.expr("pos div 16")).cast("int").alias("y"),
        (F.col("pos") % 16).cast("int").alias("x"),
        F.col("value").alias("v"),
    )


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 x 8 volumes: one x slice per embedding."""
    return embedding_series(spark, d).select(
        F.expr("series_id div 8").alias("vol_id"),
        (F.col("series_id") % 8).cast("int").alias("x"),
        F.expr("pos div 8").cast("int").alias("y"),
        (F.col("pos") % 8).cast("int").alias("z"),
        F.col("value").alias("v"),
    )


def spectra41(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, idx, nm, amp): the magnitudes of an embedding averaged onto the 41 points of the visible grid."""
    idx = F.expr("cast(pos * 41 div 64 as int)")
    grid = embedding_series(spark, d).groupBy("series_id", idx.alias("idx")).agg(F.avg(F.abs("value")).alias("amp"))
    return grid.select("series_id", "idx", (380.0 + 10 * F.col("idx")).alias("nm"), "amp")


def sparameters(spark: SparkSession, d: str) -> DataFrame:
    """(meas_id, freq, i, j, re, im): 25 embeddings give 50 frequencies of a 4-port."""
    slot = F.expr("(pos % 32) div 2")
    rows = embedding_series(spark, d).select(
        F.expr("series_id div 25").alias("meas_id"),
        (((F.col("series_id") % 25) * 2 + F.expr("pos div 32") + 1) * 4e8).alias("freq"),
        F.expr("((pos % 32) div 2) div 4").cast("int").alias("i"),
        (slot % 4).cast("int").alias("j"),
        (F.col("pos") % 2).alias("part"),
        "value",
    )
    return rows.groupBy("meas_id", "freq", "i", "j").agg(
        F.max(F.when(F.col("part") == 0, F.col("value"))).alias("re"),
        F.max(F.when(F.col("part") == 1, F.col("value"))).alias("im"),
    )


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Part-supplier graph per return flag; suppliers are the negative node ids."""
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", "l_partkey", (-F.col("l_suppkey") - 1).alias("supplier")
    )
    return edge_table(rows, "l_returnflag", "l_partkey", "supplier")


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nation graph per order priority: pairs of customer and supplier nation that trade over 1.15 times the average value.

    The aggregate has at most 625 pairs per priority, so the average is a small window.
    """
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_orderpriority", "c_nationkey", "s_nationkey")
        .agg(F.sum("l_extendedprice").alias("_value"))
    )
    mean = F.avg("_value").over(W.partitionBy("o_orderpriority"))
    rows = rows.withColumn("_mean", mean).where("_value > 1.15 * _mean")
    return edge_table(rows, "o_orderpriority", "c_nationkey", "s_nationkey")


def rationals(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, num, den) from the price and keys of every order.

    Spread over all cores by key: three numbers a row are little to move before the hundred microseconds that their
    expansion takes, and a file of few row groups is few tasks.
    """
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("num"),
        (F.col("o_custkey") * 9973 + F.col("o_orderkey") + 1).alias("den"),
    ).repartition(partitions, "seq_id")


def parameter_points(spark: SparkSession, d: str) -> DataFrame:
    """(point_id, sigma, t, kmax) from size and price of every part."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("point_id"),
        (0.4 + F.col("p_size") / 100.0).alias("sigma"),
        (F.col("p_retailprice") / 40.0).alias("t"),
        (F.col("p_partkey") % 16 + 15).cast("int").alias("kmax"),
    )
