"""Equal-width histograms and their similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spectrafold.operators.blocks import join_spread
from spectrafold.session import saved

# rows of the largest group that one task may meet, and rows of many groups that it may
GROUP, ROWS_A_TASK = 65_536, 1 << 20


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts and density of non-empty bins over the data range of each group; the right edge is closed.

    A constant group is put on a range of width one around its value.  Small groups are dealt whole over partitions of
    bounded size; where one is large, limits are repeated per salt instead.
    """
    limits = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_total")
    )
    flat = F.col("_hi") == F.col("_lo")
    limits = limits.select(
        *keys, "_total",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("_span"),
    )
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_span") * bins), F.lit(bins - 1)).cast("long")
    rows, limits = df.select(*keys, value).where(F.col(value).isNotNull()), saved(limits)
    largest, total = limits.agg(F.max("_total"), F.sum("_total")).first()
    if (largest or 0) <= GROUP:
        # no hot group: rows and limits are dealt alike, and the counts stay where the rows are
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // ROWS_A_TASK))
        rows = rows.repartition(parts, *keys).join(limits.repartition(parts, *keys).hint("shuffle_hash"), list(keys))
    else:
        rows = join_spread(rows, keys, limits, value)
    return (
        rows.groupBy(*keys, at.alias("bin"))
        .agg(F.count("*").alias("n"), F.first("_total").alias("_total"), F.first("_span").alias("_span"))
        .select(*keys, "bin", "n", (F.col("n") / (F.col("_total") * (F.col("_span") / bins))).alias("density"))
    )


def adjacent_cosine(counts: DataFrame, keys: Sequence[str], scale: str, bin_: str, n: str) -> DataFrame:
    """Cosine similarity of the histograms of scale s and s + 1, per group.

    Every count is sent to the (at most two) pairs it belongs to, so one grouping on
    (keys, pair, bin) and one on (keys, pair) do it, without a join.
    """
    sides = F.array(
        F.struct(F.col(scale).alias("pair"), F.col(n).cast("double").alias("lo"), F.lit(0.0).alias("hi")),
        F.struct((F.col(scale) - 1).alias("pair"), F.lit(0.0).alias("lo"), F.col(n).cast("double").alias("hi")),
    )
    cells = counts.select(*keys, bin_, F.explode(sides).alias("_s")).groupBy(*keys, F.col("_s.pair").alias("pair"), bin_).agg(
        F.sum("_s.lo").alias("lo"), F.sum("_s.hi").alias("hi")
    )
    sums = cells.groupBy(*keys, "pair").agg(
        F.sum(F.col("lo") * F.col("hi")).alias("dot"), F.sum(F.col("lo") ** 2).alias("nl"), F.sum(F.col("hi") ** 2).alias("nh")
    )
    return sums.where("nl > 0 AND nh > 0").select(
        *keys, "pair", (F.col("dot") / (F.sqrt("nl") * F.sqrt("nh"))).alias("cosine")
    )
