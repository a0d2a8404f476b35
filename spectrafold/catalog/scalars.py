"""Projections and row-wise transforms."""


from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import POINTS, SERIES, SPARAM, primes, with_
from spectrafold.functions import scalar as s
from spectrafold.functions.rules import first_match
from spectrafold.operators import euler
from spectrafold.sources import driver, tables as t

TERMS = """terms AS (
  SELECT point_id, kmax, k, p, ln_p, CASE p % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS chi,
    exp(-sigma * ln_p) * cos(t * ln_p) AS zr, -exp(-sigma * ln_p) * sin(t * ln_p) AS zi FROM points JOIN primes ON k <= kmax)"""


@query(with_(primes(1500), POINTS, TERMS) + """SELECT point_id, sum(zr) AS power_re, sum(zi) AS power_im,
  sum((1 - chi * zr) / ((1 - chi * zr) ^ 2 + (chi * zi) ^ 2)) AS factor_re,
  sum(chi * zi / ((1 - chi * zr) ^ 2 + (chi * zi) ^ 2)) AS factor_im,
  sum(ln_p * (chi * zr * (1 - chi * zr) - chi * chi * zi * zi) / ((1 - chi * zr) ^ 2 + (chi * zi) ^ 2)) AS deriv_re,
  sum(ln_p * chi * zi / ((1 - chi * zr) ^ 2 + (chi * zi) ^ 2)) AS deriv_im FROM terms GROUP BY 1""",
       "power_re power_im factor_re factor_im deriv_re deriv_im")
def character_sums(spark, d):
    """Prime powers, local factors and log-derivative terms of the character mod 4."""
    chi = spark.createDataFrame([(1, 1.0), (3, -1.0)], "residue long, coef double")
    primes_ = euler.character_coefficients(t.prime_table(spark, 1500), chi, 4)
    terms = euler.point_terms(driver.parameter_points(spark, d), primes_)
    re, im = s.prime_power("p", "ln_p", "sigma", "t")
    terms = terms.withColumn("zr", re).withColumn("zi", im)
    fr, fi = s.local_factor(F.col("zr"), F.col("zi"), "coef")
    dr, di = s.log_derivative(F.col("zr"), F.col("zi"), "ln_p", "coef")
    return terms.groupBy("point_id").agg(
        F.sum("zr").alias("power_re"), F.sum("zi").alias("power_im"), F.sum(fr).alias("factor_re"),
        F.sum(fi).alias("factor_im"), F.sum(dr).alias("deriv_re"), F.sum(di).alias("deriv_im"),
    )


@query(with_(primes(1500), POINTS, """w AS (SELECT point_id, k, exp(-sigma * ln_p) AS w FROM points JOIN primes ON k <= kmax),
  b AS (SELECT point_id, k, w / sum(w) OVER (PARTITION BY point_id ORDER BY k) AS b FROM w)""") +
       "SELECT point_id, CAST(k AS INTEGER) AS k, b / (1 + b) AS envelope FROM b", "envelope")
def envelope_weights(spark, d):
    terms = euler.point_terms(driver.parameter_points(spark, d), t.prime_table(spark, 1500))
    return euler.envelope(terms).select("point_id", "k", F.col("fb").alias("envelope"))


@query("""SELECT p_partkey, r / (1 + r) AS radius, 1 - r / (1 + r) AS gap, (1.5 + 0.5 * cos(a)) * cos(b) AS x,
  (1.5 + 0.5 * cos(a)) * sin(b) AS y, 0.5 * sin(a) AS z, exp(-pi() * (p_size / 50.0::DOUBLE) ^ 2) AS taper
  FROM (SELECT p_partkey, p_size, p_retailprice / 1000.0::DOUBLE AS r, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part) q""",
       "radius gap x y z taper")
def torus_projection(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 1000.0).alias("r"), "p_retailprice")
    x, y, z = s.torus_point(F.lit(0.5), F.col("p_size"), F.col("p_retailprice"))
    radius = s.compactified("r")
    return part.select("p_partkey", radius.alias("radius"), (1 - radius).alias("gap"), x.alias("x"), y.alias("y"), z.alias("z"),
                       s.taper("p_size", F.lit(50.0)).alias("taper"))


@query("""WITH RECURSIVE steps AS (
  SELECT p_partkey, p_partkey + 2 AS n, CAST(p_size AS BIGINT) AS base, 1 AS k, CAST(p_size % (p_partkey + 2) AS BIGINT) AS power FROM part
  UNION ALL SELECT p_partkey, n, base, k + 1, (power * base) % n FROM steps WHERE k < 100 AND power <> 1),
  hit AS (SELECT p_partkey, min(k) AS k FROM steps WHERE power = 1 GROUP BY 1)
  SELECT p_partkey, CAST(coalesce(k, 100) AS BIGINT) AS degree,
    CASE WHEN p_partkey = 0 THEN 0 ELSE round(log2(p_partkey & -p_partkey)) END AS v2,
    gcd(p_partkey, CAST(p_size AS BIGINT)) AS common, CAST(p_partkey % 7 AS BIGINT) = 3 AS chosen
  FROM part LEFT JOIN hit USING (p_partkey)""", "v2")
def modular_orders(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", "p_size")
    return part.select(
        "p_partkey", s.embedding_degree("p_size", F.col("p_partkey") + 2).alias("degree"), s.valuation2("p_partkey").alias("v2"),
        s.gcd("p_partkey", "p_size").alias("common"), (F.col("p_partkey") % 7 == 3).alias("chosen"),
    )


@query("""SELECT k, log2(1 + 1.0::DOUBLE / (k * (k + 2))) AS pmf, 1 - log2(1 + 1.0::DOUBLE / (k + 1)) AS cdf, n FROM (
  SELECT CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1) q""", "pmf cdf")
def quantity_against_gauss_kuzmin(spark, d):
    counts = t.table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("k")).agg(F.count("*").alias("n"))
    return counts.select("k", s.gauss_kuzmin("k").alias("pmf"), s.gauss_kuzmin_cdf("k").alias("cdf"), "n")


@query("""SELECT p_partkey, p_partkey >= 2 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 1000)) AS v) x
    WHERE v * v <= p_partkey AND p_partkey % v = 0) AS prime,
  (((-16 * (4 * (p_partkey % 97) ^ 3 + 27 * p_size ^ 2)) % 97) + 97) % 97 = 0 AS singular FROM part""")
def arithmetic_predicates(spark, d):
    return t.table(spark, d, "part").select(
        "p_partkey", t.is_prime("p_partkey").alias("prime"),
        (s.discriminant_mod("p_partkey", "p_size", F.lit(97)) == 0).alias("singular"),
    )


@query(with_(SPARAM) + """SELECT meas_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, avg(sqrt(re * re + im * im)) AS mag,
  avg(20 * log10(sqrt(re * re + im * im) + 1e-15)) AS db, max(atan2(im, re)) AS max_angle FROM sparam GROUP BY ALL""",
       "mag db max_angle")
def port_magnitudes(spark, d):
    size = s.magnitude("re", "im")
    return driver.sparameters(spark, d).groupBy("meas_id", "i", "j").agg(
        F.avg(size).alias("mag"), F.avg(s.decibel(size)).alias("db"), F.max(F.atan2("im", "re")).alias("max_angle")
    )


@query("""SELECT s_suppkey, CASE WHEN range_ > 1e-15 THEN (s_acctbal - low) / range_ ELSE s_acctbal END AS scaled FROM supplier
  JOIN (SELECT s_nationkey, min(s_acctbal) AS low, max(s_acctbal) - min(s_acctbal) AS range_ FROM supplier GROUP BY 1) USING (s_nationkey)""",
       "scaled")
def min_max_scaled(spark, d):
    rows = t.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    limits = rows.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    span = F.col("high") - F.col("low")
    scaled = F.when(span > 1e-15, (F.col("s_acctbal") - F.col("low")) / span).otherwise(F.col("s_acctbal"))
    return rows.join(limits, "s_nationkey").select("s_suppkey", scaled.alias("scaled"))


@query(with_(SERIES) + """SELECT series_id, pos, CASE WHEN std > 1e-15 THEN (value - mean) / std ELSE value - mean END AS z,
  value / peak AS scaled FROM series
  JOIN (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, max(abs(value)) AS peak FROM series GROUP BY 1) USING (series_id)
  """, "z scaled")
def normalised_series(spark, d):
    """Z-normalised and max-abs scaled values of whole series."""
    series = driver.embedding_series(spark, d)
    stats = series.groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max(F.abs("value")).alias("peak")
    )
    centred = F.col("value") - F.col("mean")
    return series.join(stats, "series_id").select(
        "series_id", "pos", F.when(F.col("std") > 1e-15, centred / F.col("std")).otherwise(centred).alias("z"),
        (F.col("value") / F.col("peak")).alias("scaled"),
    )


@query("""SELECT event_id, abs(value - round_even(value / 7, 0) * 7) < 7 * 0.05::DOUBLE AS near_multiple,
  CASE WHEN value > 50 THEN 'HIGH' WHEN value > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN value > 50 THEN printf('value %.2f above 50', value) WHEN value > 20 THEN printf('value %.2f above 20', value)
    ELSE 'within range' END AS reason, least(value, 60.0) AS capped FROM events WHERE value IS NOT NULL""", "capped")
def event_rules(spark, d):
    """Near-harmonic test, first-match classification and a cap."""
    v = F.col("value")
    verdict, reason = first_match(
        [(v > 50, "HIGH", F.format_string("value %.2f above 50", v)), (v > 20, "MEDIUM", F.format_string("value %.2f above 20", v))],
        ("LOW", F.lit("within range")),
    )
    return t.table(spark, d, "events").where(v.isNotNull()).select(
        "event_id", s.near_harmonic("value", F.lit(7.0)).alias("near_multiple"), verdict.alias("severity"), reason.alias("reason"),
        F.least(v, F.lit(60.0)).alias("capped"),
    )


