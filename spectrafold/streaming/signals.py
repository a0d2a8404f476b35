"""Windowed signal statistics of sensor events, as streams and as batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from spectrafold.functions import stats
from spectrafold.operators.blocks import dense_index, running_sum

STAT_COLUMNS = ("n", "mean", "std", "kurtosis", "rms", "crest", "energy")
CHANGE_SCHEMA = "sensor long, window_start timestamp, severity string, previous string"
LATE_SCHEMA = "sensor long, us long, value double, mark long, n_late long"


def event_stream(spark: SparkSession, path: str, pattern: str = "events*.parquet") -> DataFrame:
    """(sensor, ts, value) from a folder of event files; ts becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return sensor_events(files)


def sensor_events(events: DataFrame, *more: Column) -> DataFrame:
    return events.select(F.col("user_id").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), *more)


def _statistics() -> list[Column]:
    v = F.col("value")
    return [
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), stats.excess_kurtosis(v).alias("kurtosis"),
        stats.rms(v).alias("rms"), stats.crest(v).alias("crest"), F.sum(v * v).alias("energy"),
    ]


def windowed_statistics(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(sensor, window_start, window_end, statistics) over tumbling or sliding windows.

    Works on streams (give ``late``, the watermark delay; append mode) and on tables.
    """
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    table = rows.groupBy("sensor", window.alias("w")).agg(*_statistics())
    return table.select("sensor", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *STAT_COLUMNS)


def session_statistics(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """The same statistics over sessions that end after ``gap`` without events."""
    rows = events.withWatermark("ts", late) if late else events
    table = rows.groupBy("sensor", F.session_window("ts", gap).alias("w")).agg(*_statistics())
    return table.select("sensor", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *STAT_COLUMNS)


def _quantile_columns(sketch: str, probabilities: dict[str, float]) -> list[Column]:
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(q)).alias(name) for name, q in probabilities.items()]


def windowed_quantiles(
    events: DataFrame, length: str, probabilities: dict[str, float], slide: str | None = None, late: str | None = None, k: int = 200
) -> DataFrame:
    """(sensor, window_start, window_end, n, one column per entry of ``probabilities``) over windows, on streams and tables.

    A window's state is one quantile sketch of some kilobytes, whatever the number of its events. Quantiles are values
    of the window: the smallest whose rank reaches the share, exact up to ``k`` events, beyond with a rank error of
    about 1.65 % at ``k`` = 200.  Null values are left out; a window of nulls only has n = 0 and null quantiles.
    """
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    value = F.when(~F.isnan("value"), F.col("value"))
    table = rows.groupBy("sensor", window.alias("w")).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("_sketch"))
    quantiles = [F.when(F.col("n") > 0, q).alias(name) for name, q in zip(probabilities, _quantile_columns("_sketch", probabilities))]
    return table.select("sensor", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *quantiles)


def sketch_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], k: int = 200) -> DataFrame:
    """(keys, n, one column per entry of ``probabilities``): quantiles of groups too large to sort, from mergeable sketches.

    Only a sketch per task and group is shuffled, so a group with most rows costs no more than another. The rank error
    is the one of ``windowed_quantiles``.
    """
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    table = rows.groupBy(*keys).agg(F.count(number).alias("n"), F.kll_sketch_agg_double(number, F.lit(k)).alias("_sketch"))
    quantiles = [F.when(F.col("n") > 0, q).alias(name) for name, q in zip(probabilities, _quantile_columns("_sketch", probabilities))]
    return table.select(*keys, "n", *quantiles)


def severity(level: str = "rms", medium: float = 30.0, high: float = 60.0) -> Column:
    value = F.col(level)
    return F.when(value > high, "HIGH").when(value > medium, "MEDIUM").otherwise("LOW")


def severity_changes(windows: DataFrame, label: Column) -> DataFrame:
    """Batch form: windows whose severity differs from the sensor's window before; the first one counts."""
    order = W.partitionBy("sensor").orderBy("window_start")
    rows = windows.select("sensor", "window_start", label.alias("severity")).withColumn("previous", F.lag("severity").over(order))
    return rows.where(F.col("previous").isNull() | (F.col("previous") != F.col("severity")))


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else None
    rows = pd.concat(batches).sort_values("window_start")
    out = []
    for start, label in zip(rows["window_start"], rows["severity"]):
        if label != previous:
            out.append((key[0], start, label, previous))
        previous = label
    state.update((previous,))
    yield pd.DataFrame(out, columns=["sensor", "window_start", "severity", "previous"])


def stream_severity_changes(windows: DataFrame, label: Column) -> DataFrame:
    """Stream form: the state of a sensor is its last severity; only changes are emitted."""
    rows = windows.select("sensor", "window_start", label.alias("severity"))
    return rows.groupBy("sensor").applyInPandasWithState(_track, CHANGE_SCHEMA, "last string", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drain a stream into an in-memory table (tests and small results)."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def late_events(events: DataFrame, arrival: str, late_seconds: int) -> DataFrame:
    """(sensor, n_late): events more than the delay behind the largest time seen up to them, in order of ``arrival``.

    arrival is dense from 0; the running maximum is taken in blocks.
    """
    seen = running_sum(events.withColumn("_all", F.lit(0)), ["_all"], arrival, {"_seen": "ts"}, largest=True)
    late = F.col("ts") < F.col("_seen") - F.expr(f"interval {late_seconds} seconds")
    return seen.groupBy("sensor").agg(F.sum(F.when(late, 1).otherwise(0)).alias("n_late"))


def _flag_late(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs() * 1_000
    count = state.get[0] if state.exists else 0
    for rows in batches:
        old = rows[rows["us"] < mark]
        if len(old):
            yield pd.DataFrame({
                "sensor": key[0], "us": old["us"], "value": old["value"], "mark": mark, "n_late": range(count + 1, count + len(old) + 1),
            })
            count += len(old)
    state.update((count,))


def _closed(window_seconds: int) -> Column:
    """Whether the tumbling window of ``ts`` ends at the watermark or before it."""
    length = window_seconds * 10**6
    return (F.floor(F.unix_micros("ts") / length) + 1) * length <= F.unix_micros("watermark")


def stream_late_rows(events: DataFrame, delay: str, window_seconds: int) -> DataFrame:
    """The rows of a stream that come behind the watermark, beside the windows over the same stream.

    (sensor, ts, value, watermark, closed, n_late): ``watermark`` is the one of the row's micro-batch, the largest time
    of the batches before less ``delay``; ``closed`` tells that the tumbling window of ``window_seconds`` it belongs to
    ends by then; ``n_late`` numbers the late rows of a sensor, that count is the state.  Rows without a time are left out.
    """
    rows = events.withWatermark("ts", delay).where("ts IS NOT NULL").select("sensor", "ts", "value", F.unix_micros("ts").alias("us"))
    late = rows.groupBy("sensor").applyInPandasWithState(_flag_late, LATE_SCHEMA, "n long", "append", "NoTimeout")
    late = late.select("sensor", F.timestamp_micros("us").alias("ts"), "value", F.timestamp_micros("mark").alias("watermark"), "n_late")
    return late.select("sensor", "ts", "value", "watermark", _closed(window_seconds).alias("closed"), "n_late")


def late_rows(events: DataFrame, batch: str, delay_seconds: int, window_seconds: int) -> DataFrame:
    """Batch twin of ``stream_late_rows`` for rows with the number of their micro-batch: (batch, sensor, ts, value, watermark, closed).

    Batches are many fewer than rows: their largest times are one row each, the running maximum goes over those.
    """
    ends = events.groupBy(F.col(batch).alias("batch")).agg(F.max("ts").alias("_last")).withColumn("_all", F.lit(0))
    ends = dense_index(ends, ["_all"], ["batch"], "_i")
    seen = running_sum(ends, ["_all"], "_i", {"_seen": "_last"}, largest=True)
    after = seen.select((F.col("_i") + 1).alias("_i"), F.date_trunc("millisecond", F.col("_seen") - F.expr(f"interval {delay_seconds} seconds")).alias("watermark"))
    marks = seen.select("batch", "_i").join(after, "_i").select("batch", "watermark")
    rows = events.select(F.col(batch).alias("batch"), "sensor", "ts", "value").join(marks, "batch").where(F.col("ts") < F.col("watermark"))
    return rows.withColumn("closed", _closed(window_seconds))


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that the stateful steps of a running or finished query report as dropped behind the watermark.

    Windows report partial sums, one per task, sensor and window of a batch, so this is at most the number of rows.
    """
    return sum(int(step["numRowsDroppedByWatermark"]) for p in query.recentProgress for step in json.loads(p.json)["stateOperators"])
