"""Validation jobs over profile tables."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.number_theory import ZETA_CHANNELS, _atlas_sql
from spectrafold.catalog.sqltext import SERIES, with_
from spectrafold.catalog.waves import CASCADE, CASCADE_SELECT
from spectrafold.functions import stats
from spectrafold.operators.ranks import guarded_corr
from spectrafold.plans import cascade, euler, validation
from spectrafold.session import shared_path
from spectrafold.sources import driver, tables as t

MOMENTS = """m AS (SELECT series_id, label, avg(value) AS mean, stddev_pop(value) AS std, kurtosis_pop(value) AS kurt, max(value) AS peak, max(value) - min(value) AS span, count(*) * 1.0::DOUBLE AS n FROM series GROUP BY 1, 2)"""
NAMES = ["mean", "std", "kurt", "peak", "span"]


def _moments(spark, d):
    v = F.col("value")
    return driver.embedding_series(spark, d).groupBy("series_id", "label").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), stats.excess_kurtosis(v).alias("kurt"), F.max(v).alias("peak"),
        (F.max(v) - F.min(v)).alias("span"),
    )


LONG = "l AS (UNPIVOT (SELECT series_id, label, mean, std, kurt, peak, span FROM m) ON mean, std, kurt, peak, span INTO NAME feature VALUE value)"


@query(with_(SERIES, MOMENTS, LONG, """g AS (SELECT feature, avg(value) FILTER (label < 5) AS mean_a, avg(value) FILTER (label >= 5) AS mean_b, var_pop(value) FILTER (label < 5) AS va, var_pop(value) FILTER (label >= 5) AS vb FROM l GROUP BY 1)""") +
       "SELECT feature, mean_a, mean_b, abs(mean_a - mean_b) / sqrt((va + vb) / 2) AS separation, abs(mean_a - mean_b) / sqrt((va + vb) / 2) > 1 AS separates FROM g", "mean_a mean_b separation")
def group_separation(spark, d):
    return validation.group_separation(_moments(spark, d), NAMES, F.col("label") < 5)


@query(with_(SERIES, MOMENTS, "r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("std", "kurt", "peak", "span", "label")) + " FROM m)") +
       " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS input, coalesce(corr({a}, {b}), 0) AS rho, abs(coalesce(corr({a}, {b}), 0)) > 0.95 AS proxy FROM r" for a in ("std", "kurt", "peak") for b in ("span", "label")), "rho")
def proxy_screen(spark, d):
    return validation.proxy_screen(_moments(spark, d), "series_id", ["std", "kurt", "peak"], ["span", "label"])


@query(with_(SERIES, """turns AS (SELECT series_id, r, value, lead(value) OVER (PARTITION BY series_id, r ORDER BY CASE WHEN r = 0 THEN '' ELSE md5('5,' || r || ',' || pos) END, pos) AS nx
    FROM series, (SELECT unnest(range(21)) AS r) q),
  each AS (SELECT series_id, r, CASE WHEN stddev_pop(value) <= 1e-10 OR stddev_pop(nx) <= 1e-10 THEN 0 ELSE coalesce(corr(value, nx), 0) END AS s FROM turns GROUP BY 1, 2),
  g AS (SELECT series_id, max(s) FILTER (r = 0) AS observed, avg(s) FILTER (r > 0) AS baseline_mean, stddev_pop(s) FILTER (r > 0) AS baseline_std FROM each GROUP BY 1)""") +
       "SELECT *, (observed - baseline_mean) / baseline_std AS z, abs((observed - baseline_mean) / baseline_std) >= 2 AS signal FROM g", "observed baseline_mean baseline_std z")
def permutation_baseline(spark, d):
    series = driver.embedding_series(spark, d).select("series_id", "pos", "value")
    return validation.permutation_baseline(series, "series_id", "pos", "value", lambda x, y: guarded_corr(x, y))


@query(with_(*CASCADE, f"cp AS ({CASCADE_SELECT})", "e AS (" + " UNION ALL ".join(
    f"SELECT series_id, {a} AS energy, {b} AS peaks, {c} AS cross_ FROM cp" for a, b, c in (
        ("total_energy", "kurtosis_mean", "magnitude_correlation"), ("approx_energy_ratio", "kurtosis_max", "energy_autocorrelation"),
        ("detail_energy_ratio", "kurtosis_growth_rate", "self_similarity"), ("energy_slope", "kurtosis_at_fine", "spectral_flatness"), ("energy_slope_residual", "kurtosis_at_coarse", "0"))) + ")",
             "g AS (SELECT series_id, abs(corr(energy, peaks)) AS energy_peaks, abs(corr(energy, cross_)) AS energy_cross, abs(corr(peaks, cross_)) AS peaks_cross FROM e GROUP BY 1)") +
       "SELECT *, CASE WHEN greatest(energy_peaks, energy_cross, peaks_cross) < 0.5 THEN 'ORTHOGONAL' WHEN greatest(energy_peaks, energy_cross, peaks_cross) < 0.8 THEN 'PARTIAL' ELSE 'COUPLED' END AS kind FROM g", "energy_peaks energy_cross peaks_cross")
def channel_coupling(spark, d):
    profile = cascade.cascade_profile(driver.embedding_series(spark, d))
    f = cascade.FEATURES
    return validation.channel_coupling(profile, "series_id", {"energy": f[0:5], "peaks": f[12:17], "cross": f[20:24]})


@query(with_(SERIES, MOMENTS, LONG) + "SELECT feature, stddev_pop(value) AS std, avg(abs(value)) AS mean_abs, stddev_pop(value) > 0.1 * avg(abs(value)) AS discriminates FROM l GROUP BY 1", "std mean_abs")
def discriminating_features(spark, d):
    return validation.discriminating_features(_moments(spark, d), NAMES)


@query(with_(SERIES, MOMENTS, LONG) + "SELECT feature, count(*) AS n_rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_not_finite FROM l GROUP BY 1")
def feature_completeness(spark, d):
    return validation.completeness(_moments(spark, d), NAMES)


_ATLAS_KS = """points AS (SELECT p_partkey * 100 + k AS point_id, 0.4 + p_size / 100.0::DOUBLE AS sigma, p_retailprice / 40.0::DOUBLE AS t, k AS kmax
    FROM part, (SELECT unnest([15, 20, 25, 30]) AS k) ks)"""
_STABLE = ("torus_radius", "V", "fb_mean", "phase_coherence", "euler_arg")


@query("SELECT point, feature, stddev_pop(value) / (abs(avg(value)) + 1e-15) AS cv FROM (UNPIVOT (SELECT point_id // 100 AS point, " + ", ".join(_STABLE) + " FROM (" +
       _atlas_sql(ZETA_CHANNELS, _ATLAS_KS) + ") a) ON " + ", ".join(_STABLE) + " INTO NAME feature VALUE value) u GROUP BY 1, 2", "cv")
def atlas_convergence(spark, d):
    """Spread of Euler features of each part's point over K = 15, 20, 25, 30."""
    points = driver.parameter_points(spark, d).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in (15, 20, 25, 30)])))
    points = points.select(F.struct("point_id", "_k").alias("point_id"), "sigma", "t", F.col("_k").alias("kmax"))
    atlas = euler.euler_atlas(points, euler.zeta_table(t.prime_table(spark, 1500)), 30).withColumn("point", F.col("point_id.point_id"))
    return validation.convergence_cv(atlas, "point", _STABLE)


@query("""SELECT o_orderpriority AS domain, o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def verdict_rollup(spark, d):
    orders = t.table(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("verdict"))
    return validation.verdict_rollup(orders, "domain", "verdict")


@query(with_(SERIES, MOMENTS) + """SELECT 'signal' AS domain, CAST(series_id AS VARCHAR) AS obj_id, u.feature, u.value FROM m, LATERAL (SELECT 'mean' AS feature, mean AS value UNION ALL SELECT 'std', std) u
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'balance', s_acctbal FROM supplier""", "value")
def stacked_features(spark, d):
    suppliers = t.table(spark, d, "supplier").withColumnRenamed("s_acctbal", "balance")
    return validation.stacked_features({"signal": (_moments(spark, d), "series_id", ["mean", "std"]), "supplier": (suppliers, "s_suppkey", ["balance"])})


@query(with_(SERIES, MOMENTS) + "SELECT series_id, label, mean, std, kurt, peak, span FROM m", "mean std kurt peak span")
def written_features(spark, d):
    """A feature table written by label and read back; the partition column returns as what it was."""
    path = shared_path(spark, "features")
    t.feature_sink(_moments(spark, d), path, "parquet", ["label"])
    return spark.read.parquet(path).select("series_id", "label", *NAMES)
