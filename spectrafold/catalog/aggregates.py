"""Per-group statistics on embedding and event series."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import EVENTS, SERIES, with_
from spectrafold.functions import stats
from spectrafold.operators import fits, histogram, ranks
from spectrafold.sources import driver, tables as t


@query(with_(SERIES) + """SELECT series_id, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high,
  stddev_pop(value) AS std, var_pop(value) AS var, stddev_pop(value) / (avg(value) + 1e-15) AS cv,
  CASE WHEN count(*) < 4 OR stddev_pop(value) < 1e-15 THEN 0 ELSE kurtosis_pop(value) END AS kurtosis,
  sqrt(avg(value * value)) AS rms, max(value) / (sqrt(avg(value * value)) + 1e-15) AS crest, sum(value * value) AS energy
  FROM series GROUP BY 1""", "total mean low high std var cv kurtosis rms crest energy")
def signal_moments(spark, d):
    v = F.col("value")
    return driver.embedding_series(spark, d).groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), stats.cv(v).alias("cv"), stats.excess_kurtosis(v).alias("kurtosis"),
        stats.rms(v).alias("rms"), stats.crest(v).alias("crest"), F.sum(v * v).alias("energy"),
    )


@query(with_(SERIES, """p AS (SELECT series_id, pos, value * value AS w FROM series),
  c AS (SELECT series_id, sum(w) AS s, sum(w * pos) / sum(w) AS centroid FROM p GROUP BY 1),
  m AS (SELECT series_id, any_value(centroid) AS centroid, sqrt(sum(w * (pos - centroid) ^ 2) / any_value(s)) AS spread,
    sum(w * (pos - centroid) ^ 3) / any_value(s) AS m3, sum(w * (pos - centroid) ^ 4) / any_value(s) AS m4,
    -sum(CASE WHEN w > 0 THEN (w / s) * ln(w / s) ELSE 0 END) AS entropy, exp(avg(ln(greatest(w, 1e-30)))) / (avg(w) + 1e-30) AS flatness,
    sum(w) ^ 2 / sum(w * w) AS effective, sum(CASE WHEN pos < 21 THEN w ELSE 0 END) / any_value(s) AS low_share,
    avg(CASE WHEN w < 0.01 * mx THEN 1.0 ELSE 0.0 END) AS sparsity
    FROM p JOIN c USING (series_id) JOIN (SELECT series_id, max(w) AS mx FROM p GROUP BY 1) x USING (series_id) GROUP BY 1)""") +
       "SELECT series_id, centroid, spread, m3 / spread ^ 3 AS skew, m4 / spread ^ 4 AS kurt, entropy, flatness, effective, low_share, sparsity FROM m",
       "centroid spread skew kurt entropy flatness effective low_share sparsity")
def energy_distribution(spark, d):
    """Weighted moments, entropy, flatness, effective count, band share and sparsity of squared values."""
    rows = driver.embedding_series(spark, d).select("series_id", "pos", (F.col("value") * F.col("value")).alias("w"))
    first = rows.groupBy("series_id").agg(
        stats.centroid("w", "pos", 0.0).alias("centroid"), stats.entropy("w").alias("entropy"), stats.flatness("w").alias("flatness"),
        stats.effective_count("w").alias("effective"), (stats.sum_if(F.col("pos") < 21, "w") / F.sum("w")).alias("low_share"),
        F.max("w").alias("peak"),
    )
    off = F.col("pos") - F.col("centroid")
    second = rows.join(first, "series_id").groupBy("series_id", *[c for c in first.columns if c != "series_id"]).agg(
        F.sqrt(F.sum(F.col("w") * off**2) / F.sum("w")).alias("spread"), (F.sum(F.col("w") * off**3) / F.sum("w")).alias("m3"),
        (F.sum(F.col("w") * off**4) / F.sum("w")).alias("m4"), stats.share(F.col("w") < 0.01 * F.col("peak")).alias("sparsity"),
    )
    return second.select(
        "series_id", "centroid", "spread", (F.col("m3") / F.col("spread") ** 3).alias("skew"),
        (F.col("m4") / F.col("spread") ** 4).alias("kurt"), "entropy", "flatness", "effective", "low_share", "sparsity",
    )


@query(with_(EVENTS) + """SELECT series_id, n, slope, intercept, rmse, loglog FROM (
  SELECT series_id, count(*) AS n, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept,
    sqrt(greatest(regr_syy(value, pos) - regr_slope(value, pos) * regr_sxy(value, pos), 0) / count(*)) AS rmse,
    regr_slope(ln(value + 1), ln(pos + 1)) AS loglog FROM series WHERE value IS NOT NULL GROUP BY 1) WHERE n > 2""",
       "slope intercept rmse loglog")
def trend_fits(spark, d):
    series = t.series_table(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").where("value IS NOT NULL")
    return series.groupBy("series_id").agg(
        F.count("*").alias("n"), stats.slope("value", "pos").alias("slope"), F.regr_intercept("value", "pos").alias("intercept"),
        stats.fit_rmse("value", "pos").alias("rmse"), stats.slope(F.ln(F.col("value") + 1), F.ln(F.col("pos") + 1)).alias("loglog"),
    ).where("n > 2")


SPEARMAN_SQL = """r AS (SELECT l_suppkey,
    rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0::DOUBLE AS ry
    FROM lineitem)"""


@query(with_(SPEARMAN_SQL) + """SELECT l_suppkey, CASE WHEN stddev_pop(rx) <= 1e-10 OR stddev_pop(ry) <= 1e-10 THEN 0 ELSE corr(rx, ry) END AS rho
  FROM r GROUP BY 1""", "rho")
def rank_correlation(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    return ranks.spearman(rows, ["l_suppkey"], "l_quantity", "l_discount")


@query("""SELECT l_suppkey, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS median
  FROM lineitem GROUP BY 1""", "q10 median")
def price_quantiles(spark, d):
    return ranks.quantiles(t.table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"q10": 0.1, "median": 0.5})


@query(with_(SERIES, """s AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS c, value,
    lead(value) OVER w - avg(value) OVER (PARTITION BY series_id) AS nc, lead(value) OVER w AS nx,
    lag(value) OVER w AS px FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos))""") +
       """SELECT series_id, sum(c * nc) / sum(c * c) AS autocorr, corr(value, nx) AS lag_corr, sqrt(avg((nx - value) ^ 2)) AS roughness,
  avg(abs(CASE WHEN px IS NULL THEN nx - value WHEN nx IS NULL THEN value - px ELSE (nx - px) / 2 END)) AS gradient
  FROM s GROUP BY 1""", "autocorr lag_corr roughness gradient")
def lag_statistics(spark, d):
    """Lag-1 autocorrelation and Pearson, RMS of first differences, mean absolute gradient."""
    from spectrafold.operators.sequences import lag_features

    return lag_features(driver.embedding_series(spark, d), ["series_id"], "pos", "value")


@query(with_(SERIES, """l AS (SELECT series_id, min(abs(value)) AS lo, max(abs(value)) AS hi, count(*) AS n FROM series GROUP BY 1)""") +
       """SELECT series_id, CAST(least(floor((abs(value) - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n,
  count(*) / (any_value(l.n) * ((any_value(hi) - any_value(lo)) / 20)) AS density FROM series JOIN l USING (series_id) GROUP BY 1, 2""", "density")
def amplitude_histogram(spark, d):
    series = driver.embedding_series(spark, d).select("series_id", F.abs("value").alias("a"))
    return histogram.histogram(series, ["series_id"], "a", 20)


@query(with_("""h AS (SELECT l_returnflag AS g, l_linenumber AS s, CAST(l_quantity AS INTEGER) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
  m AS (SELECT g, s, sqrt(sum(n * n)) AS norm FROM h GROUP BY 1, 2)""") +
       """SELECT a.g AS l_returnflag, a.s AS pair, sum(a.n * b.n) / (any_value(x.norm) * any_value(y.norm)) AS cosine
  FROM h a JOIN h b ON a.g = b.g AND a.b = b.b AND b.s = a.s + 1 JOIN m x ON x.g = a.g AND x.s = a.s JOIN m y ON y.g = b.g AND y.s = b.s
  GROUP BY 1, 2""", "cosine")
def histogram_similarity(spark, d):
    """Quantity histograms of adjacent line numbers."""
    counts = t.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", F.col("l_quantity").cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )
    return histogram.adjacent_cosine(counts, ["l_returnflag"], "l_linenumber", "bin", "n")


@query("""WITH x AS (SELECT l_suppkey AS g, l_extendedprice / 1e4 AS y, l_quantity AS a, l_discount AS b FROM lineitem),
  m AS (SELECT g, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay,
    covar_pop(b, y) AS byy, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x GROUP BY 1),
  c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)
  SELECT g AS l_suppkey, my - ca * ma - cb * mb AS c0, ca AS c1, cb AS c2, (ca * ay + cb * byy) / yy AS r2 FROM c""", "c0 c1 c2 r2")
def price_regression(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1e4).alias("y"), "l_quantity", "l_discount")
    return fits.least_squares(rows, ["l_suppkey"], "y", ["l_quantity", "l_discount"])
