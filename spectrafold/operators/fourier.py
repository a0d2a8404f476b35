"""Discrete Fourier transforms as grouped sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _turn(re: Column, im: Column, step: Column, size: int) -> tuple[Column, Column]:
    """(re + i im) * exp(-2 pi i step / size); step is reduced first to keep the angle small."""
    angle = F.lit(2 * math.pi / size) * (step % size)
    c, s = F.cos(angle), F.sin(angle)
    return re * c + im * s, im * c - re * s


def _stage(df: DataFrame, keys: Sequence[str], inner: Column, freq: str, freqs: int, size: int) -> DataFrame:
    """Sum (re, im) over ``inner`` for each frequency 0..freqs-1 of a transform of length size."""
    rows = df.withColumn("_inner", inner).withColumn(freq, F.explode(F.sequence(F.lit(0), F.lit(freqs - 1))))
    re, im = _turn(F.col("re"), F.col("im"), F.col("_inner") * F.col(freq), size)
    return rows.groupBy(*keys, freq).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def dft(series: DataFrame, keys: Sequence[str], pos: str, value: str, size: int) -> DataFrame:
    """(keys, bin, re, im) for all bins of real series of one length.

    With size = a * b the transform is two passes of short transforms (a + b products
    per sample instead of size); a prime size falls back to the direct sum.
    """
    a = max(d for d in range(1, math.isqrt(size) + 1) if size % d == 0)
    rows = series.select(*keys, F.col(pos).alias("_n"), F.col(value).alias("re"), F.lit(0.0).alias("im"))
    if a == 1:
        return _stage(rows, keys, F.col("_n"), "bin", size, size)
    b = size // a
    rows = rows.withColumn("_low", F.col("_n") % b)
    first = _stage(rows, [*keys, "_low"], F.expr(f"_n div {b}"), "_ka", a, a)
    re, im = _turn(F.col("re"), F.col("im"), F.col("_low") * F.col("_ka"), size)
    first = first.select(*keys, "_low", "_ka", re.alias("re"), im.alias("im"))
    second = _stage(first, [*keys, "_ka"], F.col("_low"), "_kb", b, b)
    return second.select(*keys, (F.col("_ka") + F.col("_kb") * a).cast("int").alias("bin"), "re", "im")


def dft_bins(series: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, bins: Column) -> DataFrame:
    """Only the bins listed in an array column, for instance harmonic orders."""
    rows = series.withColumn("bin", F.explode(bins))
    re, im = _turn(F.col(value), F.lit(0.0), F.col(pos) * F.col("bin"), size)
    return rows.groupBy(*keys, "bin").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def amplitude_spectrum(series: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, rate: float) -> DataFrame:
    """(keys, bin, freq, amp) with amp = 2 |X| / N for bins 0..N/2."""
    bins = dft(series, keys, pos, value, size).where(F.col("bin") <= size // 2)
    return bins.select(
        *keys, "bin", (F.col("bin") * (rate / size)).alias("freq"),
        (2.0 / size * F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("amp"),
    )


def power_2d(image: DataFrame, keys: Sequence[str], ny: int, nx: int) -> DataFrame:
    """(keys, fy, fx, power) of images of one shape, mean removed, frequencies signed as after a shift.

    Rows first, then columns; the mean only feeds the zero frequency, which is set to 0.
    """
    rows = image.select(*keys, "y", "x", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    along_x = _stage(rows, [*keys, "y"], F.col("x"), "kx", nx, nx)
    both = _stage(along_x, [*keys, "kx"], F.col("y"), "ky", ny, ny)
    signed = lambda k, n: (F.col(k) + n // 2) % n - n // 2
    power = F.when((F.col("kx") == 0) & (F.col("ky") == 0), 0.0).otherwise(F.col("re") ** 2 + F.col("im") ** 2)
    return both.select(*keys, signed("ky", ny).alias("fy"), signed("kx", nx).alias("fx"), power.alias("power"))


def radial_profile(power: DataFrame, keys: Sequence[str], ny: int, nx: int) -> DataFrame:
    """(keys, radius, power): mean power on rings 1..min(nx, ny) / 2 - 1."""
    radius = F.floor(F.sqrt(F.col("fy") ** 2 + F.col("fx") ** 2)).cast("int")
    rings = power.withColumn("radius", radius).where((F.col("radius") >= 1) & (F.col("radius") < min(ny // 2, nx // 2)))
    return rings.groupBy(*keys, "radius").agg(F.avg("power").alias("power"))


def angular_sectors(power: DataFrame, keys: Sequence[str], sectors: int = 8) -> DataFrame:
    """(keys, sector, power): summed power outside radius 1; the angle pi itself belongs to no sector."""
    width = 2 * math.pi / sectors
    at = F.floor((F.atan2(F.col("fy").cast("double"), F.col("fx").cast("double")) + F.lit(math.pi)) / F.lit(width) + F.lit(1e-9))
    rows = power.where(F.col("fy") ** 2 + F.col("fx") ** 2 > 1).withColumn("sector", at.cast("int"))
    return rows.where(F.col("sector") < sectors).groupBy(*keys, "sector").agg(F.sum("power").alias("power"))
