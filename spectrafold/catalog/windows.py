"""Ordered features of series."""

from pyspark.sql import Window as W, functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import EVENTS, SERIES, SPARAM, with_
from spectrafold.operators import blocks, ranks, sequences
from spectrafold.sources import driver, tables as t


def _events(spark, d):
    return t.series_table(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query(with_(EVENTS, """n AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nx, median(value) OVER (PARTITION BY series_id) AS med FROM series
    WINDOW w AS (PARTITION BY series_id ORDER BY pos))""") +
       """SELECT series_id, sum(CASE WHEN value > pv AND value > nx AND value > 2 * med THEN 1 ELSE 0 END)::BIGINT AS peaks,
  sum(CASE WHEN value < pv AND value < nx AND value < med / 2 THEN 1 ELSE 0 END)::BIGINT AS valleys FROM n GROUP BY 1""")
def strict_extrema(spark, d):
    """Strict local maxima above twice the median, strict minima below half of it."""
    series = _events(spark, d)
    median = ranks.quantiles(series, ["series_id"], "value", {"median": 0.5})
    last = series.groupBy("series_id").agg(F.max("pos").alias("_last"))
    rows = sequences.neighbours(series, ["series_id"], "pos", "value")
    rows = blocks.join_stats(rows, ["series_id"], "pos", median.join(last, "series_id"))
    v, a, b, m = (F.col(c) for c in ("value", "prev_value", "next_value", "median"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("series_id").agg(
        count((v > a) & (v > b) & (v > 2 * m)).alias("peaks"), count((v < a) & (v < b) & (v < m / 2)).alias("valleys")
    )


@query(with_(EVENTS, "c AS (SELECT series_id, pos, sum(value) OVER (PARTITION BY series_id ORDER BY pos) AS cum, sum(value) OVER (PARTITION BY series_id) AS total FROM series)") +
       "SELECT series_id, min(pos) AS rolloff, any_value(total) AS total FROM c WHERE cum >= 0.85 * total - 1e-9 GROUP BY 1", "total")
def value_rolloff(spark, d):
    """First position at which 85 % of the total is reached."""
    series = blocks.running_sum(_events(spark, d), ["series_id"], "pos", {"cum": "value"}, block=1024)
    total = series.groupBy("series_id").agg(F.sum("value").alias("total"), F.max("pos").alias("_last"))
    rows = blocks.join_stats(series, ["series_id"], "pos", total)
    return rows.where("cum >= 0.85 * total - 1e-9").groupBy("series_id").agg(F.min("pos").alias("rolloff"), F.first("total").alias("total"))


@query(with_(EVENTS) + """SELECT series_id, coalesce(min(CASE WHEN value < v0 - 3 THEN pos END), max(pos)) AS drop3,
  coalesce(min(CASE WHEN value < v0 - 6 THEN pos END), max(pos)) AS drop6 FROM series
  JOIN (SELECT series_id, value AS v0 FROM series WHERE pos = 0) f USING (series_id) GROUP BY 1""")
def first_crossings(spark, d):
    """First position 3 and 6 below the first value, else the last position."""
    series = _events(spark, d)
    start = series.groupBy("series_id").agg(F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("v0"), F.max("pos").alias("_last"))
    rows = blocks.join_stats(series, ["series_id"], "pos", start)
    below = lambda by: F.coalesce(F.min(F.when(F.col("value") < F.col("v0") - by, F.col("pos"))), F.max("pos"))
    return rows.groupBy("series_id").agg(below(3).alias("drop3"), below(6).alias("drop6"))


@query(with_(SERIES) + """SELECT series_id, CASE WHEN count(*) > 1 THEN max(pos) - min(pos) ELSE 0 END AS width, min_by(pos, (-value, pos)) AS argmax
  FROM series JOIN (SELECT series_id, max(value) AS top FROM series GROUP BY 1) m USING (series_id) WHERE value > top / 2 GROUP BY 1""")
def half_width(spark, d):
    series = driver.embedding_series(spark, d)
    top = series.groupBy("series_id").agg(F.max("value").alias("top"), F.max("pos").alias("_last"))
    rows = blocks.join_stats(series, ["series_id"], "pos", top).where("value > top / 2")
    best = F.min(F.struct((-F.col("value")).alias("v"), "pos"))["pos"]
    return rows.groupBy("series_id").agg(
        F.when(F.count("*") > 1, F.max("pos") - F.min("pos")).otherwise(0).alias("width"), best.alias("argmax")
    )


@query(with_(EVENTS, "h AS (SELECT series_id, pos, value > 20 AS hit, coalesce(lag(value > 20) OVER (PARTITION BY series_id ORDER BY pos), false) AS before FROM series)") +
       """SELECT series_id, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN hit AND NOT before THEN 1 ELSE 0 END)::BIGINT AS runs,
  coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN hit AND NOT before THEN 1 ELSE 0 END), 0), 0) AS mean_run FROM h GROUP BY 1""", "mean_run")
def high_value_runs(spark, d):
    return sequences.one_runs(_events(spark, d), ["series_id"], "pos", F.col("value") > 20)


@query(with_(SPARAM, """a AS (SELECT meas_id, CAST(freq / 4e8 - 1 AS BIGINT) AS pos, atan2(im, re) AS a FROM sparam WHERE i = 0 AND j = 2),
  s AS (SELECT meas_id, pos, a, a - lag(a) OVER (PARTITION BY meas_id ORDER BY pos) AS d FROM a)""") +
       """SELECT meas_id, pos, sum(CASE WHEN d IS NULL THEN a ELSE d - 2 * pi() * ceil((d - pi()) / (2 * pi())) END) OVER (PARTITION BY meas_id ORDER BY pos) AS phase FROM s""", "phase")
def unwrapped_phase(spark, d):
    rows = driver.sparameters(spark, d).where("i = 0 AND j = 2").select(
        "meas_id", (F.col("freq") / 4e8 - 1).cast("long").alias("pos"), F.atan2("im", "re").alias("angle")
    )
    return sequences.unwrapped_phase(rows, ["meas_id"], "pos", "angle").select("meas_id", "pos", "phase")


@query(with_(EVENTS) + """SELECT series_id, pos, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS centre
  FROM series QUALIFY pos >= 50""", "centre")
def moving_centre(spark, d):
    """Mean of the 50 previous values, cut into blocks with a halo of 50 rows."""
    rows = blocks.halo_window(
        _events(spark, d), ["series_id"], "pos", lambda w: {"centre": F.avg("value").over(w.rowsBetween(-50, -1))}, 50, 0, block=4096
    )
    return rows.where("pos >= 50").select("series_id", "pos", "centre")


@query("""SELECT p_brand, p_partkey, CAST(rn AS INTEGER) AS rank FROM (SELECT p_brand, p_partkey,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) q WHERE rn <= 5""")
def top_parts(spark, d):
    """Top five per brand; Spark trims every partition to five rows per brand before the shuffle."""
    order = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    part = t.table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return part.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("p_brand", "p_partkey", "rank")
