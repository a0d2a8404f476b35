"""Checks over feature tables: separation, leakage, permutation baseline, coupling, stability, completeness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.functions.fixed import EPS
from spectrafold.operators.ranks import average_ranks, guarded_corr
from spectrafold.sources.tables import melt_features


def group_separation(df: DataFrame, names: Sequence[str], is_first: Column) -> DataFrame:
    """(feature, mean_a, mean_b, separation, separates): |m1 - m2| over the pooled spread, flagged above 1."""
    long = melt_features(df.withColumn("_g", F.coalesce(is_first, F.lit(False))), ["_g"], names)
    a, b = F.when(F.col("_g"), F.col("value")), F.when(~F.col("_g"), F.col("value"))
    table = long.groupBy("feature").agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb")
    )
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    score = F.abs(F.col("mean_a") - F.col("mean_b")) / F.when(pooled > 0, pooled)
    return table.select("feature", "mean_a", "mean_b", score.alias("separation"), F.coalesce(score > 1, F.lit(False)).alias("separates"))


def proxy_screen(df: DataFrame, id_: str, features: Sequence[str], inputs: Sequence[str], limit: float = 0.95) -> DataFrame:
    """(feature, input, rho, proxy): rank correlation of every feature with every input.

    Ranks are made once per column; the products meet in one aggregation, one row per object.
    """
    names = [*features, *inputs]
    ranked = average_ranks(melt_features(df, [id_], names).where("value IS NOT NULL"), ["feature"], "value", "rank")
    wide = ranked.groupBy(id_).pivot("feature", names).agg(F.first("rank"))
    pairs = [(f, i) for f in features for i in inputs]
    table = wide.agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("input"), guarded_corr(F.col(f), F.col(i)).alias("rho")) for f, i in pairs
    ]).alias("all"))
    return table.select(F.explode("all").alias("e")).select("e.*").withColumn("proxy", F.abs("rho") > limit)


def permutation_baseline(
    df: DataFrame, obj: str, pos: str, value: str, statistic: Callable[[Column, Column], Column], rounds: int = 20, seed: int = 5
) -> DataFrame:
    """(object, observed, baseline_mean, baseline_std, z, signal) of a statistic over consecutive values.

    Round 0 is the data; in the others the values of each object are put in the order of the MD5 of "seed,round,pos",
    which any engine can repeat.  Objects hold a bounded number of values; |z| below 2 is no signal.
    """
    rows = df.select(obj, pos, value).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    place = F.when(F.col("_round") == 0, F.lit("")).otherwise(F.md5(F.concat_ws(",", F.lit(seed), "_round", pos)))
    rows = rows.withColumn("_place", place)
    after = F.lead(value).over(W.partitionBy(obj, "_round").orderBy("_place", pos))
    each = rows.withColumn("_next", after).groupBy(obj, "_round").agg(statistic(F.col(value), F.col("_next")).alias("s"))
    real, shuffled = F.when(F.col("_round") == 0, F.col("s")), F.when(F.col("_round") > 0, F.col("s"))
    table = each.groupBy(obj).agg(
        F.max(real).alias("observed"), F.avg(shuffled).alias("baseline_mean"), F.stddev_pop(shuffled).alias("baseline_std")
    )
    z = (F.col("observed") - F.col("baseline_mean")) / F.when(F.col("baseline_std") > 0, F.col("baseline_std"))
    return table.withColumn("z", z).withColumn("signal", F.coalesce(F.abs("z") >= 2, F.lit(False)))


def channel_coupling(df: DataFrame, id_: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(id, <a>_<b>.., kind): |Pearson| between sub-vectors of a profile, shorter ones padded with zeros."""
    size = max(len(g) for g in groups.values())
    padded = {k: [F.col(c) for c in g] + [F.lit(0.0)] * (size - len(g)) for k, g in groups.items()}
    names = list(groups)
    entries = F.array(*[F.struct(*[padded[n][i].alias(n) for n in names]) for i in range(size)])
    rows = df.select(id_, F.explode(entries).alias("e")).select(id_, "e.*")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    table = rows.groupBy(id_).agg(*[F.abs(guarded_corr(a, b)).alias(f"{a}_{b}") for a, b in pairs])
    top = F.greatest(*[F.col(f"{a}_{b}") for a, b in pairs])
    return table.withColumn("kind", F.when(top < 0.5, "ORTHOGONAL").when(top < 0.8, "PARTIAL").otherwise("COUPLED"))


def discriminating_features(df: DataFrame, names: Sequence[str], share: float = 0.1) -> DataFrame:
    """(feature, std, mean_abs, discriminates): spread above a share of the mean magnitude."""
    table = melt_features(df, [], names).groupBy("feature").agg(F.stddev_pop("value").alias("std"), F.avg(F.abs("value")).alias("mean_abs"))
    return table.withColumn("discriminates", F.col("std") > share * F.col("mean_abs"))


def convergence_cv(df: DataFrame, point: str, names: Sequence[str]) -> DataFrame:
    """(point, feature, cv): spread over mean magnitude of a feature across the K grid of each point."""
    long = melt_features(df, [point], names)
    return long.groupBy(point, "feature").agg((F.stddev_pop("value") / (F.abs(F.avg("value")) + F.lit(EPS))).alias("cv"))


def completeness(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, n_rows, n_missing, n_not_finite) per feature."""
    long = melt_features(df, [], names)
    v = F.col("value")
    bad = v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return long.groupBy("feature").agg(F.count("*").alias("n_rows"), count(v.isNull()).alias("n_missing"), count(bad).alias("n_not_finite"))


def verdict_rollup(df: DataFrame, domain: str, verdict: str) -> DataFrame:
    """(domain, verdict, n) with subtotals."""
    return df.rollup(domain, verdict).agg(F.count("*").alias("n"))


def stacked_features(profiles: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """(domain, obj_id, feature, value) of several profiles."""
    out = None
    for domain, (df, id_, names) in profiles.items():
        part = melt_features(df.withColumn("obj_id", F.col(id_).cast("string")), ["obj_id"], names).withColumn("domain", F.lit(domain))
        part = part.select("domain", "obj_id", "feature", "value")
        out = part if out is None else out.unionByName(part)
    return out
