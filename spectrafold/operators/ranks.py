"""Average ranks, Spearman correlation and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.functions import stats
from spectrafold.operators.blocks import dense_index, join_spread, running_sum


def tied_rank(keys: Sequence[str], value: str | Column) -> Column:
    """Average rank inside a group whose size is limited by construction."""
    window = W.partitionBy(*keys).orderBy(value)
    return (F.rank().over(window) + F.count(F.lit(1)).over(window)) / 2.0


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, bounded: bool = False) -> DataFrame:
    """Add the average rank of ``value`` within ``keys``; ties share their mean rank.

    Equal values are counted first, so a hot value is one row before anything is sorted.
    """
    if bounded:
        return df.withColumn(name, tied_rank(keys, value))
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(dense_index(counts, keys, [value], "_i"), keys, "_i", {"_upto": "_n"})
    ranked = ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranked, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho", **options) -> DataFrame:
    """Rank correlation per group; NULL becomes 0 as the published features define it."""
    ranked = average_ranks(average_ranks(df, keys, x, "_rx", **options), keys, y, "_ry", **options)
    return ranked.groupBy(*keys).agg(guarded_corr("_rx", "_ry").alias(name))


def guarded_corr(x: str | Column, y: str | Column, floor: float = 1e-10) -> Column:
    """Pearson correlation, 0 where either side is (almost) constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    flat = (F.stddev_pop(x) <= floor) | (F.stddev_pop(y) <= floor)
    return F.when(flat, 0.0).otherwise(F.coalesce(F.nanvl(stats.pearson(x, y), F.lit(0.0)), F.lit(0.0)))


def row_ranks(values: Column) -> Column:
    """Average ranks of the entries of an array, in the row: the mean of an entry's first and last place when sorted."""
    both = F.array(F.struct(F.sort_array(values).alias("up"), F.sort_array(values, asc=False).alias("down")))
    place = lambda s, v: (F.array_position(s["up"], v) + F.size(s["up"]) + 1 - F.array_position(s["down"], v)) / 2.0
    return F.transform(both, lambda s: F.transform(values, lambda v: place(s, v)))[0]


def row_rank_corr(x: Column, y: Column, floor: float = 1e-10) -> Column:
    """Correlation of the average ranks of two arrays of one length, 0 where either is (almost) constant."""
    middle = (F.size(x) + 1) / 2.0
    pairs = F.zip_with(row_ranks(x), row_ranks(y), lambda a, b: F.struct((a - middle).alias("x"), (b - middle).alias("y")))
    names = ("xy", "xx", "yy")
    total = F.aggregate(
        pairs, F.struct(*[F.lit(0.0).alias(n) for n in names]),
        lambda s, p: F.struct(*[(s[n] + p[n[0]] * p[n[1]]).alias(n) for n in names]),
        lambda s: F.when(F.least(s["xx"], s["yy"]) > floor**2 * F.size(x), s["xy"] / F.sqrt(s["xx"] * s["yy"])))
    return F.coalesce(total, F.lit(0.0))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], bounded: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles ``{name: q}`` per group."""
    if not keys:
        return quantiles(df.withColumn("_one", F.lit(0)), ["_one"], value, qs, bounded).drop("_one")
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    if bounded:
        return rows.groupBy(*keys).agg(*[F.percentile(value, q).alias(n) for n, q in qs.items()])
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(dense_index(counts, keys, [value], "_i"), keys, "_i", {"_upto": "_n"})
    size = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size"))
    placed = join_spread(ranked, keys, size, value)
    columns = []
    for name, q in qs.items():
        at = (F.col("_size") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        first = F.col("_upto") - F.col("_n")
        v_low = F.max(F.when((first <= low) & (low < F.col("_upto")), F.col(value)))
        v_high = F.max(F.when((first <= high) & (high < F.col("_upto")), F.col(value)))
        share = F.max(at - low)
        columns.append((v_low + (v_high - v_low) * share).alias(name))
    return placed.groupBy(*keys).agg(*columns)
