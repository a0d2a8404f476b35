"""Profiles of quotient arrays: the long table and the row form agree; ranks of arrays against pandas."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from spectrafold.operators import quotients, ranks
from spectrafold.plans import quotient


def test_long_table_and_rows_agree(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(-10**6, 10**9), rng.randrange(1, 10**9)) for k in range(40)] + [(40, 0, 5), (41, 7, 1), (42, -1, 10**9), (43, 10**17, 3**36)]
    rationals = spark.createDataFrame(rows, "seq_id long, num long, den long")
    long, short = quotients.expand_rationals(rationals), quotients.rational_rows(rationals)
    assert sorted(quotient.cf_profile(long).collect()) == sorted(quotient.cf_profile_rows(short).collect())
    for seq_id, num, den in rows:
        terms = [r.a for r in long.where(F.col("seq_id") == seq_id).orderBy("k").collect()] if seq_id >= 38 else []
        while terms:
            assert terms.pop(0) == num // den
            num, den = den, num % den
            assert (den == 0) == (not terms)


def test_rank_correlation_of_arrays(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]) for k, n in enumerate([3, 9, 30, 90])]
    rows += [(4, [1, 1, 1], [1, 2, 3]), (5, [], [])]
    frame = spark.createDataFrame(rows, "i long, x array<long>, y array<long>")
    for row in frame.withColumn("rho", ranks.row_rank_corr(F.col("x"), F.col("y"))).collect():
        x, y = pd.Series(row.x, dtype=float).rank(), pd.Series(row.y, dtype=float).rank()
        want = x.corr(y) if len(x) > 1 and x.nunique() > 1 and y.nunique() > 1 else 0.0
        assert abs(row.rho - want) < 1e-9


def test_pairs_equal_ranks_and_counts_row_by_row(spark):
    rng = random.Random(4)
    arrays = [(k, [rng.choice([1, 1, 2, 3, 11, 40, 10**12]) for _ in range(rng.randrange(0, 12))]) for k in range(60)]
    sequences = spark.createDataFrame([(k, a, 1) for k, a in arrays], "seq_id long, a array<long>, q long")
    pairs = spark.createDataFrame([(k, (k * 7 + 3) % 60) for k in range(60)] + [(1, 10)], "a long, b long")
    frame = quotient.cf_cross_rows(sequences, pairs)
    assert "MapInArrow" in frame._jdf.queryExecution().sparkPlan().toString()
    of = dict(arrays)
    got = frame.collect()
    assert len(got) == sum(min(len(of[k]), len(of[(k * 7 + 3) % 60])) > 0 for k in [*range(60), 1])
    for row in got:
        n = min(len(of[row.a]), len(of[row.b]))
        x, y = of[row.a][:n], of[row.b][:n]
        if n < 3:
            assert list(row)[2:] == [None] * 4
            continue
        rx, ry = pd.Series(x, dtype=float).rank(), pd.Series(y, dtype=float).rank()
        assert abs(row.cross_corr - (rx.corr(ry) if len({*x}) > 1 and len({*y}) > 1 else 0.0)) < 1e-9
        assert row.shared_large == sum(u > 10 and v > 10 for u, v in zip(x, y)) / n
        assert row.gcd_coprime == sum(math.gcd(u, v) == 1 for u, v in zip(x, y)) / n
        share = lambda values: pd.Series(values).value_counts() / n
        cells, i, j = share([(u % 3, v % 3) for u, v in zip(x, y)]), share([u % 3 for u in x]), share([v % 3 for v in y])
        want = sum(c * math.log2(c / (i[at[0]] * j[at[1]])) for at, c in cells.items())
        assert abs(row.mod_mutual_info - want) < 1e-9
