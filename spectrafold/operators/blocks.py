"""Windows that never hold a whole group in one task.

Series positions are dense integers, so a long series can be cut into blocks of
fixed length.  A block plus a few copied edge rows (the halo) is all that lag,
lead and moving frames need; running sums need the totals of earlier blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.session import checkpointed

BLOCK = 65_536


def in_parts(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """df dealt by ``keys`` into partitions of some ``size`` rows, so that a task's work does not grow with the table.

    Not fewer than the session's partitions; windows and groupings by ``keys`` need no further shuffle.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // size)), *keys)


def _div(column: str, size: int) -> Column:
    return F.expr(f"`{column}` div {int(size)}L")


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    build: Callable[[object], dict[str, Column]],
    before: int = 1,
    after: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Add the columns ``build(window)`` returns; frames may look ``before`` rows back and ``after`` ahead.

    ``pos`` must be dense from 0 within ``keys``.  One shuffle on (keys, block).
    """
    if before + after >= block:
        raise ValueError("the frame must be shorter than a block")
    home = _div(pos, block)
    offset = F.col(pos) % block
    owners = (
        F.when((offset < after) & (home > 0), F.array(home, home - 1))
        .when(offset >= block - before, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    copies = df.withColumn("_block", F.explode(owners))
    window = W.partitionBy(*keys, "_block").orderBy(pos)
    for name, column in build(window).items():
        copies = copies.withColumn(name, column)
    return copies.where(F.col("_block") == _div(pos, block)).drop("_block")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: dict[str, str],
    block: int = BLOCK,
    bounded: bool = False,
    largest: bool = False,
) -> DataFrame:
    """Inclusive running sums ``{new: source}`` along ``pos`` (running maxima with ``largest``).

    With ``bounded`` the caller states that an object's length is limited by
    construction (an array held in one row, a fixed grid), and a plain window is used.
    """
    fold = F.max if largest else F.sum
    start = F.lit(None) if largest else F.lit(0)
    plus = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: a + b)
    if bounded:
        window = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[fold(src).over(window).alias(new) for new, src in sums.items()])
    keys = list(keys)
    earlier = (W.unboundedPreceding, -1)
    rows = df.withColumn("_block", _div(pos, block))
    totals = (
        rows.groupBy(*keys, "_block")
        .agg(*[fold(src).alias(f"_t_{new}") for new, src in sums.items()])
        .withColumn("_super", _div("_block", block))
    )
    coarse = totals.groupBy(*keys, "_super").agg(*[fold(f"_t_{new}").alias(f"_u_{new}") for new in sums])
    over_super = W.partitionBy(*keys).orderBy("_super").rowsBetween(*earlier)
    coarse = coarse.select(
        *keys, "_super", *[F.coalesce(fold(f"_u_{n}").over(over_super), start).alias(f"_v_{n}") for n in sums]
    )
    over_block = W.partitionBy(*keys, "_super").orderBy("_block").rowsBetween(*earlier)
    offsets = totals.join(coarse, [*keys, "_super"]).select(
        *keys,
        "_block",
        *[plus(F.coalesce(fold(f"_t_{n}").over(over_block), start), F.col(f"_v_{n}")).alias(f"_o_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *[fold(src).over(inside).alias(f"_i_{new}") for new, src in sums.items()])
    joined = summed.join(offsets, [*keys, "_block"])
    for new in sums:
        joined = joined.withColumn(new, plus(F.col(f"_i_{new}"), F.col(f"_o_{new}")))
    return joined.drop("_block", *[f"_i_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos", bounded: bool = False
) -> DataFrame:
    """Number the rows of every group from 0 in a total ``order``.

    Rows are range partitioned on (keys, order), so a hot group is spread over many sorted partitions, and only
    one count per partition and group is summed up. With ``bounded`` the caller states that a group's size is
    limited by construction; then one window does it.
    """
    if bounded:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return ranged_index(df, keys, order, name)


def ranged_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """dense_index without any per-group window over rows."""
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))
    runs = ordered.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    runs = runs.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, "_part"]})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_part"]]  # rows without a key are a group, too
    return (
        ordered.join(runs, same).drop(*[f"_k_{c}" for c in [*keys, "_part"]])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_before"))
        .drop("_row", "_part", "_first", "_before")
    )


def join_stats(df: DataFrame, keys: Sequence[str], pos: str, stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """Attach one row of statistics per group without meeting all rows of a hot group in one task.

    The statistics carry the largest position as ``_last``; they are repeated once per
    block of positions and joined on (keys, block).
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), _div("_last", block)))
    spread = stats.withColumn("_block", blocks).drop("_last")
    return df.withColumn("_block", _div(pos, block)).join(spread, [*keys, "_block"]).drop("_block")


def consecutive_pairs(df: DataFrame, keys: Sequence[str], id_: str) -> DataFrame:
    """(keys, a, b): every id with its successor inside the group, a list of pairs that grows linearly."""
    rows = dense_index(df.select(*keys, F.col(id_).alias("a")), keys, ["a"], "_i")
    paired = halo_window(rows, keys, "_i", lambda w: {"b": F.lead("a").over(w)}, before=0)
    return paired.where("b IS NOT NULL").select(*keys, "a", "b")


def join_spread(df: DataFrame, keys: Sequence[str], stats: DataFrame, spread_by: str | Column, salts: int = 64) -> DataFrame:
    """Attach one row per group like join_stats, for rows without a position.

    Rows get a salt from a hash of ``spread_by`` and the statistics are repeated per salt,
    so a group that holds most rows is met in ``salts`` parts.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", salt).join(repeated, [*keys, "_salt"]).drop("_salt")
