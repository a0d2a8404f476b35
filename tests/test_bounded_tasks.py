"""Work is dealt by its amount, not by a fixed number of partitions, with the same results."""

from pyspark.sql import functions as F

from spectrafold.operators import histogram
from spectrafold.plans import euler
from spectrafold.sources import tables


def _partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def _points(spark, n=120):
    return spark.range(n).select(
        F.col("id").alias("point_id"), (0.4 + F.col("id") / 100).alias("sigma"), (F.col("id") / 4 + 3).alias("t"),
        (F.col("id") % 16 + 15).cast("int").alias("kmax"))


def test_points_of_the_atlas_are_dealt_by_their_number(spark, monkeypatch):
    table = euler.zeta_table(tables.prime_table(spark, 200))
    whole = {r.point_id: r for r in euler.euler_atlas(_points(spark), table, 40).collect()}
    monkeypatch.setattr(euler, "POINTS_A_TASK", 8, raising=False)
    parts = euler.euler_atlas(_points(spark), table, 40)
    assert _partitions(parts) > 4 and {r.point_id: r for r in parts.collect()} == whole


def test_points_of_trajectories_are_dealt_by_their_number(spark, monkeypatch):
    primes = tables.prime_table(spark, 1500)
    whole = {r.point_id: r for r in euler.trajectory_scales(_points(spark), primes).collect()}
    monkeypatch.setattr(euler, "POINTS_A_TASK", 8, raising=False)
    parts = euler.trajectory_scales(_points(spark), primes)
    assert _partitions(parts) > 4 and {r.point_id: r for r in parts.collect()} == whole


def test_candidates_are_refined_over_all_partitions(spark):
    rows = spark.createDataFrame([(k, 100.0 + 7 * k) for k in range(40)], "pos long, t double").coalesce(1)
    found = euler.valley_refine(rows)
    assert _partitions(found) > 1
    assert sorted(r.pos for r in found.collect()) == list(range(40))
    zero = euler.valley_refine(spark.createDataFrame([(1, 14.15)], "pos long, t double")).first()
    assert abs(zero.gamma - 14.134725) < 1e-5 and zero.accepted


def test_small_groups_of_a_histogram_are_dealt_whole(spark, monkeypatch):
    rows = spark.range(40).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"))
    rows = rows.select("g", F.when(F.col("k") < 30, F.pmod(F.xxhash64("g", "k"), F.lit(100)) / 7).alias("v"))
    whole = {(r.g, r.bin): r for r in histogram.histogram(rows, ["g"], "v", 9).collect()}
    monkeypatch.setattr(histogram, "ROWS_A_TASK", 100, raising=False)
    parts = histogram.histogram(rows, ["g"], "v", 9)
    assert _partitions(parts) > 4 and {(r.g, r.bin): r for r in parts.collect()} == whole
    monkeypatch.setattr(histogram, "GROUP", 10, raising=False)
    assert {(r.g, r.bin): r for r in histogram.histogram(rows, ["g"], "v", 9).collect()} == whole
