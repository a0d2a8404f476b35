"""Peak finding with height, distance and prominence, for all series at once.

A peak is a local maximum (the middle of a plateau counts).  Filters apply in the
order height, distance, prominence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.operators.blocks import dense_index, halo_window
from spectrafold.session import checkpointed

FAN = 64


def local_maxima(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, keep: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """(keys, pos, value, keep): strict maxima and plateau midpoints, edges excluded."""
    rows = df.select(*keys, pos, value, *keep)
    build = lambda w: {"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}
    if bounded:
        window = W.partitionBy(*keys).orderBy(pos)
        rows = rows.select("*", *[c.alias(n) for n, c in build(window).items()])
    else:
        rows = halo_window(rows, keys, pos, build)
    v, a, b = F.col(value), F.col("_a"), F.col("_b")
    single = rows.where((a < v) & (v > b)).select(*keys, pos, value, *keep)
    # a plateau shows as one rising edge and one falling edge next to each other among all plateau edges
    start, end = (a.isNull() | (a != v)) & (b == v), (a == v) & (b.isNull() | (b != v))
    edges = rows.where(start | end).select(*keys, pos, value, *keep, start.alias("_start"), (a < v).alias("_up"), (b < v).alias("_down"))
    after = lambda w: {"_end": F.lead(pos).over(w), "_falls": F.lead("_down").over(w)}
    if bounded:
        window = W.partitionBy(*keys).orderBy(pos)
        edges = edges.select("*", *[c.alias(n) for n, c in after(window).items()])
    else:
        edges = halo_window(dense_index(edges, keys, [pos], "_i"), keys, "_i", after, before=0)
    flat = edges.where(F.col("_start") & F.col("_up") & F.col("_falls"))
    middle = F.floor((F.col(pos) + F.col("_end")) / 2).cast(df.schema[pos].dataType)
    return single.unionByName(flat.select(*keys, middle.alias(pos), value, *keep))


def spaced(peaks: DataFrame, keys: Sequence[str], pos: str, value: str, distance: Column | int, bounded: bool = False) -> DataFrame:
    """Keep the highest peaks so that kept ones are at least ``distance`` apart (later wins a tie)."""
    if isinstance(distance, int) and distance <= 2:
        return peaks
    if bounded:
        return _spaced_by_cluster(peaks, keys, pos, value, F.lit(distance) if isinstance(distance, int) else distance)
    if not isinstance(distance, int):
        raise ValueError("series of unlimited length need one integer distance")
    return _spaced_by_rounds(peaks, keys, pos, value, distance)


def _spaced_by_cluster(peaks, keys, pos, value, distance):
    """Peaks closer than distance form clusters; each is thinned inside one row."""
    window = W.partitionBy(*keys).orderBy(pos)
    rows = peaks.withColumn("_d", distance.cast("long"))
    gap = F.col(pos) - F.lag(pos).over(window)
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap >= F.col("_d")), 1).otherwise(0))
    rows = rows.withColumn("_cluster", F.sum("_new").over(window))
    others = [c for c in peaks.columns if c not in (*keys,)]
    entry = F.struct(F.col(value).alias("_v"), F.col(pos).cast("long").alias("_p"), F.struct(*others).alias("row"))
    clusters = rows.groupBy(*keys, "_cluster").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("all"), F.max("_d").alias("_d")
    )
    kept = F.aggregate(
        "all",
        F.expr("filter(all, e -> false)"),
        lambda acc, e: F.when(
            F.exists(acc, lambda k: F.abs(k["_p"] - e["_p"]) < F.col("_d")), acc
        ).otherwise(F.concat(acc, F.array(e))),
    )
    return clusters.select(*keys, F.explode(kept).alias("e")).select(*keys, "e.row.*")


def _spaced_by_rounds(peaks, keys, pos, value, distance):
    """Per round every peak that leads its surroundings is kept and its surroundings are dropped."""
    reach = distance - 1
    block = max(65_536, 4 * distance)
    names = peaks.columns
    kept, rest = None, checkpointed(peaks)
    while not rest.isEmpty():
        best = lambda w: {"_best": F.max(F.struct(value, pos)).over(w.rangeBetween(-reach, reach))}
        marked = halo_window(rest, keys, pos, best, reach, reach, block).withColumn(
            "_lead", F.when(F.col("_best")[pos] == F.col(pos), 1).otherwise(0)
        )
        near = lambda w: {"_near": F.max("_lead").over(w.rangeBetween(-reach, reach))}
        marked = checkpointed(halo_window(marked.drop("_best"), keys, pos, near, reach, reach, block))
        leaders = marked.where("_lead = 1").select(*names)
        kept = leaders if kept is None else kept.unionByName(leaders)
        rest = marked.where("_near = 0").select(*names)
    return peaks.limit(0) if kept is None else kept


def prominences(
    df: DataFrame, peaks: DataFrame, keys: Sequence[str], pos: str, value: str, length: int | None = None, to: str = "prominence"
) -> DataFrame:
    """Height of each peak above the higher of its two bases.

    The base on a side is the minimum up to the next higher sample.  Samples are
    summed up in a pyramid of blocks (max and min, fan-out 64), so a peak meets at most
    64 entries per level however long its series is.
    """
    keys = list(keys)
    if length is None:
        length = (df.agg(F.max(pos)).first()[0] or 0) + 1
    levels = max(1, math.ceil(math.log(max(length, 2)) / math.log(FAN) - 1e-12))
    nodes = df.select(*keys, F.col(pos).cast("long").alias("_idx"), F.col(value).alias("_mx"), F.col(value).alias("_mn"))
    arrays = []
    for level in range(levels):
        blocks = nodes.groupBy(*keys, F.expr(f"_idx div {FAN}").alias("_blk")).agg(
            F.collect_list(F.struct("_idx", "_mx", "_mn")).alias("_children"), F.max("_mx").alias("_mx"), F.min("_mn").alias("_mn")
        )
        arrays.append(blocks.select(*keys, "_blk", "_children"))
        nodes = blocks.select(*keys, F.col("_blk").alias("_idx"), "_mx", "_mn")
    none = F.lit(None).cast("long")
    state = peaks.withColumns({"_p": F.col(pos).cast("long"), "_v": F.col(value)})
    for side in "lr":
        state = state.withColumns({f"_low_{side}": F.col("_v"), f"_stop_{side}": none, f"_at_{side}": none})
    for level, blocks in enumerate(arrays):
        state = state.withColumn("_blk", F.expr(f"_p div {FAN ** (level + 1)}")).join(blocks, [*keys, "_blk"], "left")
        node = F.expr(f"_p div {FAN ** level}")
        state = state.withColumns({f"_found_{side}": _search(side, _beside(side, node)) for side in "lr"})
        state = state.withColumns({
            name: column
            for side in "lr"
            for name, column in _updated(side, F.col(f"_stop_{side}").isNull(), F.lit(level)).items()
        }).drop("_found_l", "_found_r")
        state = state.drop("_children", "_blk")
    for level in range(levels - 1, 0, -1):
        for side in "lr":
            here = F.col(f"_at_{side}") >= level
            state = state.withColumn("_blk", F.when(here, F.col(f"_stop_{side}"))).join(arrays[level - 1], [*keys, "_blk"], "left")
            state = state.withColumn(f"_found_{side}", _search(side, lambda c: F.lit(True)))
            state = state.withColumns(_updated(side, here, F.lit(level))).drop("_children", "_blk", f"_found_{side}")
    result = F.col("_v") - F.greatest("_low_l", "_low_r")
    return state.select(*peaks.columns, result.alias(to))


def _beside(side: str, node: Column):
    return (lambda c: c["_idx"] < node) if side == "l" else (lambda c: c["_idx"] > node)


def _search(side: str, inside) -> Column:
    """STRUCT<stop, low>: index of the nearest child above the peak on one side, and the minimum up to it.

    The index is bound as a lambda variable, so it is worked out once per row and not once per child.
    """
    above = F.filter("_children", lambda c: inside(c) & (c["_mx"] > F.col("_v")))
    stop = (F.array_max if side == "l" else F.array_min)(F.transform(above, lambda c: c["_idx"]))

    def with_minimum(s):
        between = (lambda c: c["_idx"] > s) if side == "l" else (lambda c: c["_idx"] < s)
        passed = F.filter("_children", lambda c: inside(c) & F.coalesce(between(c), F.lit(True)))
        low = F.coalesce(F.array_min(F.transform(passed, lambda c: c["_mn"])), F.col("_v"))
        return F.struct(s.alias("stop"), low.alias("low"))

    return F.get(F.transform(F.array(stop), with_minimum), F.lit(0))


def _updated(side: str, active: Column, level: Column) -> dict[str, Column]:
    """State columns of one side after a search that applies where ``active``."""
    found = F.col(f"_found_{side}")
    low, stop, at = (F.col(f"_{n}_{side}") for n in ("low", "stop", "at"))
    hit = active & found["stop"].isNotNull()
    return {
        f"_low_{side}": F.when(active, F.least(low, found["low"])).otherwise(low),
        f"_stop_{side}": F.when(hit, found["stop"]).otherwise(stop),
        f"_at_{side}": F.when(hit & at.isNull(), level).otherwise(at),
    }


def find_peaks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    height: Column | None = None,
    distance: Column | int | None = None,
    prominence: Column | None = None,
    keep: Sequence[str] = (),
    length: int | None = None,
) -> DataFrame:
    """Peaks of every series; thresholds may be columns of df listed in ``keep``.

    ``length`` states that no series is longer by construction (fixed grids, arrays of one row);
    a position beyond it stops the job.
    """
    bounded = length is not None
    if bounded:
        fits = F.col(pos) < length
        df = df.withColumn(pos, F.when(fits, F.col(pos)).otherwise(F.raise_error(F.lit(f"a series is longer than the declared {length}"))))
    peaks = local_maxima(df, keys, pos, value, keep, bounded)
    if height is not None:
        peaks = peaks.where(F.col(value) >= height)
    if distance is not None:
        peaks = spaced(peaks, keys, pos, value, distance, bounded)
    if prominence is not None:
        peaks = prominences(df, peaks, keys, pos, value, length).where(F.col("prominence") >= prominence)
    return peaks
