"""Level statistics of sorted level lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spectrafold.functions import stats
from spectrafold.functions.fixed import EPS
from spectrafold.functions.scalar import flag, neighbour_ratio

FEATURES = (
    "n_interior param_a param_b f_0 f_1 gap ratio_21 mean_spacing std_spacing spacing_cv weyl_resid level_repulsion harmonicity spec_dim "
    "degeneracy near_degen f_4 f_9 ratio_31 f_max bandwidth median_spacing spacing_growth n_modes Q_factor regularity non_degen "
    "antenna_score acoustic_score"
).split()


def ordered_levels(df: DataFrame, obj: str, level: str) -> DataFrame:
    """(obj_id, idx, level): all levels of each object, numbered from the lowest."""
    order = W.partitionBy("obj_id").orderBy("level")
    rows = df.select(F.col(obj).alias("obj_id"), F.col(level).cast("double").alias("level"))
    return rows.withColumn("idx", F.row_number().over(order) - 1)


def level_profile(levels: DataFrame) -> DataFrame:
    """One row per obj_id from (obj_id, idx, level[, n_interior, param_a, param_b]); NULL below three levels."""
    passed = [c for c in ("n_interior", "param_a", "param_b") if c in levels.columns]
    order = W.partitionBy("obj_id").orderBy("idx")
    whole = W.partitionBy("obj_id")
    rows = levels.select(
        "*", F.lag("level").over(order).alias("_prev"), F.min("level").over(whole).alias("_f0"), F.max("level").over(whole).alias("_fm"),
        F.count("*").over(whole).alias("_n"),
    ).withColumn("_s", F.col("level") - F.col("_prev"))
    rows = rows.select("*", F.lead("_s").over(order).alias("_next"), F.avg("_s").over(whole).alias("_ms"))
    e, s, n, f0, fm = (F.col(c) for c in ("level", "_s", "_n", "_f0", "_fm"))
    i = F.col("idx") + 1
    line = i * (fm - f0) / n + f0
    norm = e / F.when(f0 > 1e-10, f0)
    at = lambda k: F.max(F.when(F.col("idx") == F.least(F.lit(k), n - 1), e))
    first, last = F.max(F.when(F.col("idx") == 1, s)), F.max(F.when(i == n, s))
    table = rows.groupBy("obj_id").agg(
        *[F.max(c).cast("double").alias(c) for c in passed],
        F.max(n).cast("double").alias("n_modes"), F.min(e).alias("f_0"), at(1).alias("f_1"), at(2).alias("_f2"), at(4).alias("f_4"),
        at(9).alias("f_9"), F.max(e).alias("f_max"), F.avg(s).alias("mean_spacing"), F.stddev_pop(s).alias("std_spacing"),
        F.sqrt(F.avg((e - line) ** 2)).alias("_line"),
        F.avg(neighbour_ratio(s, F.col("_next"))).alias("_rep"), F.count(s).alias("_ns"),
        F.avg(F.when(F.col("idx") < 10, F.abs(norm - F.rint(norm)))).alias("_dev"),
        (2 * stats.slope(F.ln(i.cast("double")), F.ln(e + F.lit(EPS)))).alias("_dim"),
        F.sum(flag(s < F.col("_ms") * 0.01)).alias("degeneracy"), F.sum(flag(s < F.col("_ms") * 0.1)).alias("near_degen"),
        F.percentile(s, 0.5).alias("median_spacing"), first.alias("_s0"), last.alias("_s1"),
    )
    for name in ("n_interior", "param_a", "param_b"):
        if name not in passed:
            table = table.withColumn(name, F.lit(None).cast("double"))
    c = F.col
    positive = c("f_0") > 1e-10
    table = table.withColumns({
        "gap": c("f_1") - c("f_0"),
        "ratio_21": F.when(positive, c("f_1") / F.when(positive, c("f_0"))).otherwise(0.0),
        "ratio_31": F.when(positive, c("_f2") / F.when(positive, c("f_0"))).otherwise(0.0),
        "spacing_cv": c("std_spacing") / (c("mean_spacing") + F.lit(EPS)),
        "weyl_resid": F.when(c("f_max") > c("f_0"), c("_line") / (c("mean_spacing") + F.lit(EPS))).otherwise(0.0),
        "level_repulsion": F.when(c("_ns") > 2, c("_rep")).otherwise(0.0),
        "harmonicity": F.when(positive, c("_dev")).otherwise(1.0),
        "spec_dim": F.when(c("n_modes") > 5, c("_dim")).otherwise(0.0),
        "bandwidth": c("f_max") / (c("f_0") + F.lit(EPS)),
        "spacing_growth": F.when((c("_ns") > 1) & (c("_s0") > 1e-10), c("_s1") / (c("_s0") + F.lit(EPS))).otherwise(0.0),
        "non_degen": flag(c("degeneracy") == 0),
    })
    table = table.withColumns({
        "Q_factor": c("gap") / (c("f_0") + F.lit(EPS)), "regularity": 1.0 / (c("spacing_cv") + F.lit(EPS)),
    })
    table = table.withColumns({
        "antenna_score": c("Q_factor") * 0.4 + c("regularity") * 0.003 + c("non_degen") * 0.2,
        "acoustic_score": 0.3 / (c("spacing_cv") + 0.01) + 0.3 / (c("weyl_resid") + 0.01) + (1 - c("harmonicity")) * 0.4,
    })
    enough = c("n_modes") >= 3
    return table.select("obj_id", *[F.when(enough, c(f)).alias(f) for f in FEATURES])


def largest_gap(levels: DataFrame, search: int = 10) -> DataFrame:
    """(obj_id, max_gap, max_gap_idx): largest level[i + 1] - level[i] for i in 1..min(n - 1, search) - 1; first wins."""
    order = W.partitionBy("obj_id").orderBy("idx")
    rows = levels.select(
        "obj_id", "idx", (F.lead("level").over(order) - F.col("level")).alias("gap"), F.count("*").over(W.partitionBy("obj_id")).alias("n")
    )
    usable = (F.col("idx") >= 1) & (F.col("idx") < F.least(F.col("n") - 1, F.lit(search))) & (F.col("gap") > 0)
    best = F.min(F.when(usable, F.struct((-F.col("gap")).alias("g"), F.col("idx").alias("i"))))
    table = rows.groupBy("obj_id").agg(best.alias("b"))
    return table.select(
        "obj_id", F.coalesce(-F.col("b.g"), F.lit(0.0)).alias("max_gap"), F.coalesce(F.col("b.i"), F.lit(0)).cast("double").alias("max_gap_idx")
    )
