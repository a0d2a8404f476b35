import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import peaks


def _brute(x):
    out, i, n = {}, 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                m = (i + j) // 2
                left = next((k for k in range(m, -1, -1) if x[k] > x[m]), -1)
                right = next((k for k in range(m, n) if x[k] > x[m]), n)
                out[m] = x[m] - max(min(x[left + 1: m + 1]), min(x[m:right]))
            i = j + 1
        else:
            i += 1
    return out


def _thinned(found, x, distance):
    keep = set(found)
    for m in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if m in keep:
            keep -= {k for k in keep if k != m and abs(k - m) < distance}
    return keep


def test_plateaus_prominence_and_distance_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(peaks, "FAN", 8)  # three pyramid levels on 400 samples
    x = np.round(np.cumsum(np.random.default_rng(3).normal(size=400)), 0)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g long, pos long, v double").repartition(3)
    want = _brute(x)
    got = {r.pos: r.prominence for r in peaks.find_peaks(df, ["g"], "pos", "v", prominence=F.lit(0.0)).collect()}
    assert got == want
    thinned = _thinned(want, x, 9)
    assert {r.pos for r in peaks.find_peaks(df, ["g"], "pos", "v", distance=9).collect()} == thinned
    assert {r.pos for r in peaks.find_peaks(df, ["g"], "pos", "v", distance=9, length=400).collect()} == thinned


def test_height_and_prominence_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 2.0, 1.0, 3.0, 0.0])], "g long, pos long, v double")
    found = peaks.find_peaks(df, ["g"], "pos", "v", height=F.lit(2.0), prominence=F.lit(1.0), length=5)
    assert {(r.pos, r.prominence) for r in found.collect()} == {(1, 1.0), (3, 3.0)}


def test_a_series_longer_than_declared_stops_the_job(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(50)], "g string, pos long, v double")
    with pytest.raises(Exception, match="longer than the declared"):
        peaks.find_peaks(df, ["g"], "pos", "v", prominence=F.lit(1.0), length=20).collect()
