import math

import pytest
from pyspark.sql import functions as F

from spectrafold.plans import channel
from spectrafold.sources import tables, touchstone
from spectrafold.streaming import signals

DATA = "/root/testdata/sf0.001"


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    batch = signals.windowed_statistics(signals.sensor_events(spark.read.parquet(f"{DATA}/events.parquet")), "1 day")
    stream = signals.windowed_statistics(signals.event_stream(spark, DATA), "1 day", late="1 hour")
    got = {(r.sensor, r.window_start): r for r in signals.run_to_table(stream, "windows", str(tmp_path / "a")).collect()}
    want = {(r.sensor, r.window_start): r for r in batch.collect()}
    assert got and set(got) <= set(want)
    last = max(s for _, s in want)
    assert {k for k in want if k[1] < last} <= set(got)  # only windows still open are missing
    for key, row in got.items():
        assert row.n == want[key].n and math.isclose(row.energy, want[key].energy, rel_tol=1e-9)


def test_stream_severity_changes_equal_batch(spark, tmp_path):
    windows = signals.windowed_statistics(signals.sensor_events(spark.read.parquet(f"{DATA}/events.parquet")), "1 day")
    folder = str(tmp_path / "w")
    windows.coalesce(1).write.parquet(folder)
    stored = spark.read.parquet(folder)
    stream = signals.stream_severity_changes(spark.readStream.schema(stored.schema).parquet(folder), signals.severity())
    got = {tuple(r) for r in signals.run_to_table(stream, "changes", str(tmp_path / "b")).collect()}
    want = {tuple(r) for r in signals.severity_changes(stored, signals.severity()).select("sensor", "window_start", "severity", "previous").collect()}
    assert got == want and got


def test_sessions_in_a_stream(spark, tmp_path):
    stream = signals.session_statistics(signals.event_stream(spark, DATA), "6 hours", late="1 hour")
    got = signals.run_to_table(stream, "sessions", str(tmp_path / "c"))
    want = signals.session_statistics(signals.sensor_events(spark.read.parquet(f"{DATA}/events.parquet")), "6 hours")
    assert got.join(want, ["sensor", "window_start", "n"]).count() == got.count() > 0


def test_late_rows_of_a_stream_equal_the_batch_twin(spark, tmp_path):
    rows = [(k % 3, 3600 * k - (40_000 if k % 5 == 4 else 0) - (9 if k % 7 == 6 else 0), float(k), k // 8) for k in range(64)] + [(1, None, 0.0, 2), (0, 25_000, 1.0, 1)]
    table = spark.createDataFrame(rows, "sensor long, s long, value double, batch long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    folder = tmp_path / "in"
    for batch in range(8):
        table.where(F.col("batch") == batch).select("sensor", "ts", "value").coalesce(1).write.mode("append").parquet(str(folder))
    arriving = lambda: spark.readStream.schema("sensor long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = signals.run_to_table(signals.stream_late_rows(arriving(), "60 seconds", 3600), "late", str(tmp_path / "l")).collect()
    want = signals.late_rows(table, "batch", 60, 3600).select("sensor", "ts", "value", "watermark", "closed").collect()
    assert {tuple(r)[:5] for r in got} == {tuple(r) for r in want} and len(got) == len(want) > 0
    assert {r.closed for r in got} == {True, False}
    for sensor in {r.sensor for r in got}:
        numbers = sorted(r.n_late for r in got if r.sensor == sensor)
        assert numbers == list(range(1, len(numbers) + 1))
    windows = signals.windowed_statistics(arriving(), "1 hour", late="60 seconds")
    query = (
        windows.writeStream.format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "h")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert 0 < signals.dropped_by_watermark(query) <= sum(r.closed for r in got)


def test_window_quantiles_in_a_stream_equal_batch(spark, tmp_path):
    shares = {"low": 0.1, "median": 0.5}
    stream = signals.windowed_quantiles(signals.event_stream(spark, DATA), "1 day", shares, late="1 hour")
    got = {(r.sensor, r.window_start): r for r in signals.run_to_table(stream, "quantiles", str(tmp_path / "q")).collect()}
    batch = signals.windowed_quantiles(signals.sensor_events(spark.read.parquet(f"{DATA}/events.parquet")), "1 day", shares)
    want = {(r.sensor, r.window_start): r for r in batch.collect()}
    assert got and all(want[k] == r for k, r in got.items())


def test_sketch_quantiles_of_a_large_group(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("g"), F.pmod(F.col("id") * 7_919, F.lit(200_000)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("b", 3), ("b", None), ("b", 9), ("c", None)], "g string, v long"))
    got = {r.g: r for r in signals.sketch_quantiles(rows, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}).collect()}
    for name, share in (("q1", 0.1), ("q5", 0.5), ("q9", 0.9)):
        assert abs(got["a"][name] / 200_000 - share) < 0.03
    assert (got["b"].n, got["b"].q5, got["b"].q9) == (2, 3.0, 9.0)
    assert (got["c"].n, got["c"].q5) == (0, None)


@pytest.mark.parametrize("unit,scale", [("HZ", 1.0), ("KHZ", 1e3), ("MHZ", 1e6), ("GHZ", 1e9)])
@pytest.mark.parametrize("layout", ["MA", "DB", "RI"])
def test_touchstone_units_and_layouts(spark, tmp_path, unit, scale, layout):
    def pair(s):
        re, im = 0.1 + s / 40, 0.05 - s / 100
        size, angle = math.hypot(re, im), math.degrees(math.atan2(im, re))
        return {"RI": (re, im), "MA": (size, angle), "DB": (20 * math.log10(size), angle)}[layout]

    numbers = [1e9 / scale] + [v for s in range(16) for v in pair(s)] + [2e9 / scale, 0.5]  # the second record is cut off
    body = " ".join(repr(v) for v in numbers[:10]) + " ! note 1 2 3\n" + "\n".join(repr(v) for v in numbers[10:])
    (tmp_path / "a.s4p").write_text(f"! header\n# {unit} S {layout} R 50\n{body}\n")
    rows = touchstone.read_touchstone(spark, str(tmp_path)).collect()
    assert len(rows) == 16
    for r in rows:
        s = r.i * 4 + r.j
        assert abs(r.freq - 1e9) < 1 and abs(r.re - (0.1 + s / 40)) < 1e-9 and abs(r.im - (0.05 - s / 100)) < 1e-9


def test_mode_blocks_of_an_ideal_through_line(spark):
    links = {(0, 2), (2, 0), (1, 3), (3, 1)}
    rows = [("m", 1e9, i, j, 0.9 if (i, j) in links else 0.0, 0.0) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "meas_id string, freq double, i int, j int, re double, im double")
    row = channel.mixed_mode(df, channel.PROFILE_MODES).first()
    assert abs(row.dd21_re - 0.9) < 1e-12 and abs(row.cc21_re - 0.9) < 1e-12 and row.dc21_re == 0.0


def test_feature_sink_keeps_columns(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 0.5).alias("x"))
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        tables.feature_sink(df, path, fmt)
        assert sorted(r.x for r in spark.read.format(fmt).load(path).collect()) == [0.0, 0.5, 1.0, 1.5, 2.0]
