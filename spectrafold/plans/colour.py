"""Colour profile of 41-point visible spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spectrafold.functions import stats
from spectrafold.functions.fixed import EPS, OBSERVER_X, OBSERVER_Y, OBSERVER_Z
from spectrafold.functions.scalar import neighbour_ratio
from spectrafold.operators.peaks import find_peaks

FEATURES = (
    "X Y Z dominant_wl peak_wl peak_amp bandwidth_50 n_peaks mean_spacing spacing_cv level_repulsion spec_entropy centroid spread "
    "skewness kurtosis_spec red_ratio green_ratio blue_ratio uv_energy smoothness flatness purity metamer_dim low_freq_E mid_freq_E "
    "high_freq_E total_power crest_factor"
).split()
POINTS = 41


def observer_table(spark: SparkSession) -> DataFrame:
    """(idx, nm, xbar, ybar, zbar): the standard observer on the 41-point grid."""
    rows = [(i, 380.0 + 10 * i, *v) for i, v in enumerate(zip(OBSERVER_X, OBSERVER_Y, OBSERVER_Z))]
    return spark.createDataFrame(rows, "idx int, nm double, xbar double, ybar double, zbar double")


def color_profile(spectrum: DataFrame, observer: DataFrame) -> DataFrame:
    """One row per series_id from (series_id, idx, nm, amp); other lengths than 41 give NULL features."""
    order, whole = W.partitionBy("series_id").orderBy("idx"), W.partitionBy("series_id")
    rows = spectrum.select(
        "series_id", "idx", "nm", "amp", F.max("amp").over(whole).alias("_max"), F.sum("amp").over(whole).alias("_sum"),
        (F.sum(F.col("nm") * F.col("amp")).over(whole) / (F.sum("amp").over(whole) + F.lit(EPS))).alias("_c"),
        F.lag("amp").over(order).alias("_prev"),
    ).join(F.broadcast(observer.drop("nm")), "idx")
    s, nm, i, total = F.col("amp"), F.col("nm"), F.col("idx"), F.col("_sum") + F.lit(EPS)
    off = nm - F.col("_c")
    above = s > 0.5 * F.col("_max")
    bright = F.when(s > 1e-10, s)
    table = rows.groupBy("series_id").agg(
        F.count("*").alias("_n"), *[(10.0 * F.sum(s * F.col(b))).alias(n) for n, b in (("X", "xbar"), ("Y", "ybar"), ("Z", "zbar"))],
        F.min(F.struct((-(s * F.col("xbar") + s * F.col("ybar"))).alias("v"), nm.alias("nm")))["nm"].alias("dominant_wl"),
        F.max("_max").alias("_max"),
        F.when(F.sum(F.when(above, 1).otherwise(0)) > 1, F.max(F.when(above, nm)) - F.min(F.when(above, nm))).otherwise(0.0).alias("bandwidth_50"),
        (-F.sum(s / total * F.ln(s / total + F.lit(EPS)))).alias("spec_entropy"), F.max("_c").alias("centroid"),
        F.sqrt(F.sum(off**2 * s) / F.max(total)).alias("spread"), F.sum(off**3 * s / total).alias("_m3"), F.sum(off**4 * s / total).alias("_m4"),
        stats.sum_if(i >= 24, s).alias("_r"), stats.sum_if((i >= 12) & (i < 24), s).alias("_g"), stats.sum_if(i < 12, s).alias("_b"),
        stats.sum_if(i < 4, s).alias("_uv"), F.sqrt(F.avg((s - F.col("_prev")) ** 2)).alias("smoothness"),
        F.coalesce(F.exp(F.avg(F.ln(bright))) / (F.avg(bright) + F.lit(EPS)), F.lit(0.0)).alias("flatness"),
        stats.sum_if(i < 13, s).alias("_lo"), stats.sum_if((i >= 13) & (i < 26), s).alias("_mid"), stats.sum_if(i >= 26, s).alias("_hi"),
        F.sum(s).alias("total_power"), stats.crest(s).alias("crest_factor"), F.stddev_pop(s).alias("_std"),
    )
    table = table.join(peak_features(spectrum), "series_id", "left")
    c = F.col
    xyz = c("X") + c("Y") + c("Z") + F.lit(EPS)
    band, power, width = c("_r") + c("_g") + c("_b") + F.lit(EPS), c("total_power") + F.lit(EPS), F.greatest(c("spread"), F.lit(1e-10))
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    table = table.withColumns({
        "peak_wl": F.coalesce("peak_wl", F.lit(580.0)), "peak_amp": F.coalesce("peak_amp", "_max"), "n_peaks": zero("n_peaks"),
        "mean_spacing": zero("mean_spacing"), "spacing_cv": zero("spacing_cv"), "level_repulsion": zero("level_repulsion"),
        "skewness": c("_m3") / width**3, "kurtosis_spec": c("_m4") / width**4, "red_ratio": c("_r") / band, "green_ratio": c("_g") / band,
        "blue_ratio": c("_b") / band, "uv_energy": c("_uv") / power,
        "purity": F.sqrt((c("X") / xyz - 1 / 3) ** 2 + (c("Y") / xyz - 1 / 3) ** 2) / 0.3,
        # a rank-one matrix has one eigenvalue; a flat spectrum none, which sorts to the end
        "metamer_dim": F.when(c("_std") < F.lit(EPS), 42.0).otherwise(1.0),
        "low_freq_E": c("_lo") / power, "mid_freq_E": c("_mid") / power, "high_freq_E": c("_hi") / power,
    })
    valid = c("_n") == POINTS
    return table.select("series_id", *[F.when(valid, c(f)).alias(f) for f in FEATURES])


def peak_features(spectrum: DataFrame) -> DataFrame:
    """First peak, peak count and the spacing statistics of peaks (prominence 5 % of the maximum, distance 3)."""
    rows = spectrum.select("series_id", "idx", "nm", "amp", F.max("amp").over(W.partitionBy("series_id")).alias("_max"))
    peaks = find_peaks(rows, ["series_id"], "idx", "amp", distance=3, prominence=F.col("_max") * 0.05, keep=["_max"], length=POINTS)
    order = W.partitionBy("series_id").orderBy("idx")
    nm = 380.0 + 10 * F.col("idx")
    peaks = peaks.select("series_id", "idx", nm.alias("nm"), "amp", (nm - F.lag(nm).over(order)).alias("_s"))
    peaks = peaks.withColumn("_next", F.lead("_s").over(order))
    s, b = F.col("_s"), F.col("_next")
    return peaks.groupBy("series_id").agg(
        F.count("*").cast("double").alias("n_peaks"), F.min_by("nm", "idx").alias("peak_wl"), F.min_by("amp", "idx").alias("peak_amp"),
        F.avg(s).alias("mean_spacing"), (F.stddev_pop(s) / (F.avg(s) + F.lit(EPS))).alias("spacing_cv"),
        F.avg(neighbour_ratio(s, b)).alias("level_repulsion"),
    )


def metamer_comparison(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, xyz_distance, feature_distance) of requested pairs of objects."""
    base = profile.select("series_id", F.array("X", "Y", "Z").alias("xyz"), F.array(*FEATURES).alias("f"))
    rows = pairs.select("a", "b").join(base.select(F.col("series_id").alias("a"), F.col("xyz").alias("x1"), F.col("f").alias("f1")), "a")
    rows = rows.join(base.select(F.col("series_id").alias("b"), F.col("xyz").alias("x2"), F.col("f").alias("f2")), "b")
    gap = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
    return rows.select("a", "b", gap("x1", "x2").alias("xyz_distance"), gap("f1", "f2").alias("feature_distance"))
