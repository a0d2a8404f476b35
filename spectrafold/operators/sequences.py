"""Features of ordered series: neighbours, spacings, runs, crossings, unwrapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from spectrafold.functions import stats
from spectrafold.functions.fixed import EPS
from spectrafold.functions.scalar import wrapped
from spectrafold.operators.blocks import halo_window, running_sum


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str, bounded: bool = False) -> DataFrame:
    """Add prev_value and next_value."""
    if bounded:
        window = W.partitionBy(*keys).orderBy(pos)
        return df.select("*", F.lag(value).over(window).alias("prev_value"), F.lead(value).over(window).alias("next_value"))
    return halo_window(
        df, keys, pos, lambda w: {"prev_value": F.lag(value).over(w), "next_value": F.lead(value).over(w)}
    )


def lag_features(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Lag-1 autocorrelation and Pearson, RMS of the first difference, mean absolute gradient.

    sum((x - m)(x' - m)) is expanded, so the mean needs no pass of its own.
    """
    rows = neighbours(df, keys, pos, value)
    v, before, after = F.col(value), F.col("prev_value"), F.col("next_value")
    gradient = (
        F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    )
    table = rows.groupBy(*keys).agg(
        F.avg(v).alias("_m"), F.var_pop(v).alias("_var"), F.count(v).alias("_n"), F.covar_pop(v, after).alias("_cov"),
        F.avg(F.when(after.isNotNull(), v)).alias("_a"), F.avg(after).alias("_b"), F.count(after).alias("_pairs"),
        stats.pearson(v, after).alias("lag_corr"), F.sqrt(F.avg((after - v) ** 2)).alias("roughness"),
        F.avg(F.abs(gradient)).alias("gradient"),
    )
    cross = F.col("_pairs") * (F.col("_cov") + (F.col("_a") - F.col("_m")) * (F.col("_b") - F.col("_m")))
    norm = F.col("_n") * F.col("_var")
    return table.select(
        *keys, F.when(norm > F.lit(EPS), cross / norm).otherwise(0.0).alias("autocorr"), "lag_corr", "roughness", "gradient"
    )


def spacings(df: DataFrame, keys: Sequence[str], level: str, keep: Sequence[str] = (), min_spacing: float | None = None) -> DataFrame:
    """Adjacent spacings of ascending levels with their successor; objects hold a bounded number of levels."""
    window = W.partitionBy(*keys).orderBy(level)
    rows = df.select(*keys, *keep, level, (F.col(level) - F.lag(level).over(window)).alias("spacing")).where("spacing IS NOT NULL")
    if min_spacing is not None:
        rows = rows.where(F.col("spacing") > min_spacing)
    after = F.lead("spacing").over(window)
    s = F.col("spacing")
    ratio = F.least(s, after) / (F.greatest(s, after) + F.lit(EPS))
    return rows.withColumn("repulsion", F.when(after.isNotNull(), ratio))


def one_runs(df: DataFrame, keys: Sequence[str], pos: str, hit) -> DataFrame:
    """Mean run length of consecutive rows where ``hit`` holds, 0 without any.

    Mean length = hits / runs, and a run starts where the previous row misses: no run needs to be assembled.
    """
    rows = df.select(*keys, pos, F.when(hit, 1).otherwise(0).alias("_hit"))
    rows = halo_window(rows, keys, pos, lambda w: {"_before": F.lag("_hit").over(w)}, after=0)
    start = F.when((F.col("_hit") == 1) & (F.coalesce("_before", F.lit(0)) == 0), 1).otherwise(0)
    table = rows.groupBy(*keys).agg(F.sum("_hit").alias("hits"), F.sum(start).alias("runs"))
    return table.select(*keys, "hits", "runs", F.when(F.col("runs") > 0, F.col("hits") / F.col("runs")).otherwise(0.0).alias("mean_run"))


def unwrapped_phase(df: DataFrame, keys: Sequence[str], pos: str, angle: str, to: str = "phase", bounded: bool = False) -> DataFrame:
    """Phase without 2 pi jumps: first angle plus the running sum of wrapped steps."""
    if bounded:
        window = W.partitionBy(*keys).orderBy(pos)
        rows = df.withColumn("_before", F.lag(angle).over(window))
    else:
        rows = halo_window(df, keys, pos, lambda w: {"_before": F.lag(angle).over(w)}, after=0)
    step = F.when(F.col("_before").isNull(), F.col(angle)).otherwise(wrapped(F.col(angle) - F.col("_before")))
    return running_sum(rows.withColumn("_step", step).drop("_before"), keys, pos, {to: "_step"}, bounded=bounded).drop("_step")


