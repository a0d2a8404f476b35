"""Haar wavelets: every level of every object in one shuffle.

A coefficient of level l is a signed sum over 2^l samples, so each sample is sent
straight to the block it belongs to on every level and summed there (with map-side
partial sums).  Missing partners count as zero, which equals zero padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

APPROX = 0


def haar_1d(series: DataFrame, levels: int) -> DataFrame:
    """(series_id, level, pos, coef); level 0 holds the final approximation.

    Needs series_id, pos, value and, where known, the length ``n``.
    """
    if "n" not in series.columns:
        size = series.groupBy("series_id").agg((F.max("pos") + 1).alias("n"), F.max("pos").alias("_last"))
        from spectrafold.operators.blocks import join_stats

        series = join_stats(series, ["series_id"], "pos", size)
    depth = F.least(F.ceil(F.log2(F.col("n").cast("double"))), F.lit(levels)).cast("int")
    target = F.transform(
        F.sequence(F.lit(1), F.col("depth")),
        lambda l: F.struct(
            l.alias("level"),
            F.call_function("shiftright", F.col("pos"), l).alias("at"),
            (F.when(F.call_function("shiftright", F.col("pos"), l - 1) % 2 == 0, 1.0).otherwise(-1.0)
             * F.pow(F.lit(2.0), -l / 2.0)).alias("w"),
        ),
    )
    smooth = F.array(
        F.struct(
            F.lit(APPROX).alias("level"),
            F.call_function("shiftright", F.col("pos"), F.col("depth")).alias("at"),
            F.pow(F.lit(2.0), -F.col("depth") / 2.0).alias("w"),
        )
    )
    rows = series.withColumn("depth", depth).where("depth >= 1")
    cells = rows.select("series_id", "value", F.explode(F.concat(target, smooth)).alias("c"))
    return cells.groupBy("series_id", F.col("c.level").alias("level"), F.col("c.at").alias("pos")).agg(
        F.sum(F.col("value") * F.col("c.w")).alias("coef")
    )


BANDS = ("LLL", "LLH", "LHL", "LHH", "HLL", "HLH", "HHL", "HHH")


def haar_3d(volume: DataFrame, levels: int) -> DataFrame:
    """(vol_id, level, x, y, z, band, coef): seven detail bands per level, LLL on the last one only."""
    cells = volume.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))

    def sign(axis):
        return F.when(F.call_function("shiftright", F.col(axis), F.col("level") - 1) % 2 == 0, 1.0).otherwise(-1.0)

    signs = {"x": sign("x"), "y": sign("y"), "z": sign("z")}
    sums = []
    for band in BANDS:
        term = F.col("v") * F.pow(F.lit(2.0), -1.5 * F.col("level"))
        for axis, kind in zip("xyz", band):
            if kind == "H":
                term = term * signs[axis]
        sums.append(F.sum(term).alias(band))
    at = [F.call_function("shiftright", F.col(a), F.col("level")).alias(a) for a in "xyz"]
    wide = cells.groupBy("vol_id", "level", *at).agg(*sums)
    long = wide.unpivot(["vol_id", "level", "x", "y", "z"], list(BANDS), "band", "coef")
    return long.where((F.col("band") != "LLL") | (F.col("level") == levels))
