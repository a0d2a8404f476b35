"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from spectrafold.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the smallest node that it reaches.

    Each round hangs the larger neighbours of every node, then the smaller ones, on the smallest neighbour, until
    nothing changes. Neighbours are never gathered: a node's minimum is a sum-like aggregate, joined back to its
    edges, so a hub's edges may be split. Each round is written to the shared folder and the one before dropped.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low).distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == digest:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        digest = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def spanning(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of matches that connect all that the boolean matrix connects.

    All matches if they are few; else a breadth-first forest, at most one per row and column.
    """
    rows, cols = np.nonzero(match)
    if len(rows) <= 2 * sum(match.shape):
        return rows, cols
    out_r, out_c = [], []
    new_row, new_col = match.any(axis=1), np.ones(match.shape[1], bool)
    while new_row.any():
        front = np.array([new_row.argmax()])
        new_row[front] = False
        while len(front):
            got = np.flatnonzero(match[front].any(axis=0) & new_col)
            new_col[got] = False
            out_r.append(front[match[np.ix_(front, got)].argmax(axis=0)] if len(got) else got)
            out_c.append(got)
            back = np.flatnonzero(match[:, got].any(axis=1) & new_row) if len(got) else got
            new_row[back] = False
            out_c.append(got[match[np.ix_(back, got)].argmax(axis=1)] if len(back) else back)
            out_r.append(back)
            front = back
    return np.concatenate(out_r), np.concatenate(out_c)
