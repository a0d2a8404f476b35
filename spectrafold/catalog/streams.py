"""Batch twins of the streaming jobs."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.sources import tables as t
from spectrafold.streaming import signals

STATS = """count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, CASE WHEN count(*) < 4 OR stddev_pop(value) < 1e-15 THEN 0 ELSE kurtosis_pop(value) END AS kurtosis,
  sqrt(avg(value * value)) AS rms, max(value) / (sqrt(avg(value * value)) + 1e-15) AS crest, sum(value * value) AS energy"""
FLOATS = "mean std kurtosis rms crest energy"


def _events(spark, d, *more):
    return signals.sensor_events(t.table(spark, d, "events"), *more)


def _plain(df):
    """Window bounds as epoch seconds, the same in both engines."""
    return df.withColumns({c: F.unix_timestamp(c) for c in ("window_start", "window_end") if c in df.columns})


@query(f"""SELECT user_id AS sensor, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS window_end, {STATS} FROM events GROUP BY 1, 2, 3""", FLOATS)
def tumbling_statistics(spark, d):
    return _plain(signals.windowed_statistics(_events(spark, d), "1 day"))


@query(f"""SELECT user_id AS sensor, s AS window_start, s + 86400 AS window_end, {STATS} FROM (SELECT *, unnest([CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200, CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200 - 43200]) AS s FROM events) q GROUP BY 1, 2, 3""", FLOATS)
def sliding_statistics(spark, d):
    return _plain(signals.windowed_statistics(_events(spark, d), "1 day", "12 hours"))


@query(f"""SELECT sensor, CAST(floor(epoch(min(ts))) AS BIGINT) AS window_start, CAST(floor(epoch(max(ts) + INTERVAL 6 HOUR)) AS BIGINT) AS window_end, {STATS} FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sensor ORDER BY ts, event_id) AS session FROM (SELECT user_id AS sensor, event_id, ts, value,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY sensor, session""", FLOATS)
def session_statistics(spark, d):
    return _plain(signals.session_statistics(_events(spark, d), "6 hours"))


@query("""WITH w AS (SELECT user_id AS sensor, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1, 2),
  s AS (SELECT sensor, window_start, CASE WHEN rms > 60 THEN 'HIGH' WHEN rms > 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM w),
  p AS (SELECT *, lag(severity) OVER (PARTITION BY sensor ORDER BY window_start) AS previous FROM s)
  SELECT sensor, window_start, severity, previous FROM p WHERE previous IS NULL OR previous <> severity""")
def severity_changes(spark, d):
    windows = signals.windowed_statistics(_events(spark, d), "1 day")
    return _plain(signals.severity_changes(windows, signals.severity()))


@query("""SELECT user_id AS sensor, CAST(sum(CASE WHEN ts < seen - INTERVAL 60 SECOND THEN 1 ELSE 0 END) AS BIGINT) AS n_late FROM (
  SELECT user_id, ts, max(ts) OVER (ORDER BY event_id // 64 * 64 + 63 - event_id % 64 ROWS UNBOUNDED PRECEDING) AS seen FROM events) q GROUP BY 1""")
def late_event_counts(spark, d):
    """Late events if every 64 event ids arrived in reverse."""
    rows = t.table(spark, d, "events").select(
        F.col("user_id").alias("sensor"), "ts", F.expr("event_id div 64 * 64 + 63 - event_id % 64").alias("arrival")
    )
    return signals.late_events(rows, "arrival", 60)


@query("""WITH r AS (SELECT user_id AS sensor, event_id // 16 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS batch, ts, value FROM events),
  m AS (SELECT batch, date_trunc('millisecond', max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 SECOND) AS mark FROM (SELECT batch, max(ts) AS last FROM r GROUP BY 1) q)
  SELECT batch, sensor, count(*) AS n_late, count(*) FILTER (floor(epoch_us(ts) / 3600000000::BIGINT) * 3600000000 + 3600000000 <= epoch_us(mark)) AS n_closed, CAST(max(epoch_us(mark) - epoch_us(ts)) AS BIGINT) AS most_late_us
  FROM r JOIN m USING (batch) WHERE ts < mark GROUP BY 1, 2""")
def late_rows_per_batch(spark, d):
    """Rows behind the watermark if 16 event ids came as one micro-batch, every seventh id one batch later, and those of closed hours."""
    rows = _events(spark, d, F.expr("event_id div 16 + if(event_id % 7 = 0, 1, 0)").alias("batch"))
    late = signals.late_rows(rows, "batch", 60, 3600)
    return late.groupBy("batch", "sensor").agg(
        F.count("*").alias("n_late"), F.count_if("closed").alias("n_closed"), F.max(F.unix_micros("watermark") - F.unix_micros("ts")).alias("most_late_us")
    )


@query("""SELECT user_id AS sensor, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS window_end, count(value) AS n,
  quantile_disc(value, 0.1) AS low, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS high FROM events GROUP BY 1, 2, 3""", "low median high")
def window_quantiles(spark, d):
    """Daily quantiles per sensor by sketches, exact in windows of up to 200 events."""
    return _plain(signals.windowed_quantiles(_events(spark, d), "1 day", {"low": 0.1, "median": 0.5, "high": 0.9}))
