"""Queries written as SQL text over the library's views and functions."""

from pyspark.sql import functions as F

from spectrafold.catalog.number_theory import ZETA_CHANNELS, ORD2
from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import POINTS, SERIES, SUPPLY, primes, with_
from spectrafold.catalog.waves import CASCADE, CASCADE_SELECT
from spectrafold.sql import SqlAccess


@query(with_(*CASCADE, f"cp AS ({CASCADE_SELECT})") + """SELECT label, verdict, count(*) AS n, avg(total_energy) AS mean_energy, max(s.energy / s.whole) AS most_low
  FROM cp JOIN (SELECT series_id, any_value(label) AS label, sum(value * value) FILTER (pos BETWEEN 0 AND 15) AS energy, sum(value * value) AS whole FROM series GROUP BY 1) s USING (series_id)
  GROUP BY 1, 2""", "mean_energy most_low")
def sql_cascade_by_label(spark, d):
    """A profile view, a canonical view and a table function in one statement."""
    return SqlAccess(spark, d).sql("""
      SELECT label, verdict, count(*) AS n, avg(total_energy) AS mean_energy, max(share) AS most_low
      FROM cascade_profile JOIN (SELECT DISTINCT series_id, label FROM series) USING (series_id) JOIN band_energy(0, 15) USING (series_id)
      GROUP BY label, verdict""")


@query(with_(primes(1500), ORD2, ZETA_CHANNELS, POINTS, """g AS (SELECT point_id, sum(exp(-sigma * ln_p) * cos(t * ln_p)) AS re, -sum(exp(-sigma * ln_p) * sin(t * ln_p)) AS im FROM points JOIN primes ON k <= 15 GROUP BY 1)""", recursive=True) +
       """SELECT point_id, re, im, sqrt(re * re + im * im) AS size, sqrt(re * re + im * im) / (1 + sqrt(re * re + im * im)) AS compact FROM g""", "re im size compact")
def sql_euler_sums(spark, d):
    """A table function of every row's own parameters, and scalar functions on its sums."""
    return SqlAccess(spark, d).sql("""
      SELECT point_id, re, im, magnitude(re, im) AS size, compactified(magnitude(re, im)) AS compact
      FROM (SELECT point_id, sum(e.re) AS re, sum(e.im) AS im FROM parameter_points q, LATERAL euler_terms(q.sigma, q.t, 15) e GROUP BY point_id)""")


@query("""SELECT user_id AS sensor, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS window_start, count(*) AS n, avg(value) AS mean, sqrt(avg(value * value)) AS rms
  FROM events GROUP BY 1, 2 HAVING count(*) >= 2""", "mean rms")
def sql_sensor_windows(spark, d):
    """A table function with the window's length as its argument."""
    return SqlAccess(spark, d).sql("SELECT sensor, window_start, n, mean, rms FROM window_statistics(21600) WHERE n >= 2")


@query(with_(SUPPLY) + """SELECT graph_id, degree, count(*) AS nodes, CASE WHEN degree = 0 THEN 0 ELSE round(log2(degree & -degree)) END AS depth
  FROM (SELECT graph_id, src, count(*) AS degree FROM edges GROUP BY 1, 2) d WHERE degree >= 3 GROUP BY 1, 2""", "depth")
def sql_degree_distribution(spark, d):
    return SqlAccess(spark, d).sql("SELECT graph_id, degree, nodes, valuation2(degree) AS depth FROM degree_distribution(3)")


@query(with_(SERIES) + """SELECT verdict, count(*) AS n, avg(spread) AS mean_spread FROM (
  SELECT CASE WHEN peak > 0.4::DOUBLE THEN 'PEAKED' WHEN spread < 0.125::DOUBLE THEN 'QUIET' ELSE 'PLAIN' END AS verdict, spread
  FROM (SELECT series_id, max(abs(value)) AS peak, stddev_pop(value) AS spread FROM series GROUP BY 1) f) v GROUP BY 1""", "mean_spread")
def declared_profile(spark, d):
    """A profile registered with its schema and rules, then used from SQL."""
    access = SqlAccess(spark, d)
    access.declare(
        "loudness", lambda spark, series: series.groupBy("series_id").agg(F.max(F.abs("value")).alias("peak"), F.stddev_pop("value").alias("spread")),
        ("series",), "series_id BIGINT, peak DOUBLE, spread DOUBLE",
        [(F.col("peak") > 0.4, "PEAKED", F.lit("peak > 0.4")), (F.col("spread") < 0.125, "QUIET", F.lit("spread < 0.125"))], ("PLAIN", "no rule holds"))
    return access.sql("SELECT verdict, count(*) AS n, avg(spread) AS mean_spread FROM loudness GROUP BY verdict")
