"""Orders by the group law against counting, and against the group itself over large fields."""

import math
import random

import pytest

from spectrafold.operators import curvegroups as cg
from spectrafold.plans.curves import curve_orders

PRIMES = [5, 7, 11, 101, 997, 1_009, 1_013, 1_021, 1_993, 1_999]


def test_orders_equal_the_table_method(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-p, 2 * p), rng.randrange(p), p) for p in PRIMES for _ in range(25)] + [(0, 5, 1_009), (3, 0, 1_021), (0, 0, 101)]
    df = spark.createDataFrame(rows, "a long, b long, p long")
    want = {(r.a, r.b, r.p): r.n_points for r in curve_orders(df).collect()}
    got = {(r.a, r.b, r.p): r.n_points for r in cg.large_curve_orders(df).collect()}
    assert set(got) == set(want)
    for (a, b, p), n in got.items():
        singular = (4 * a**3 + 27 * b**2) % p == 0
        assert n is None if singular else n == want[a, b, p]


def test_whole_group_of_a_small_prime_by_steps(monkeypatch):
    monkeypatch.setattr(cg, "DIRECT", 461)  # steps from 461 on, where curve and twist leave one number
    for a in range(0, 461, 23):
        for b in range(0, 461, 19):
            if (4 * a**3 + 27 * b**2) % 461:
                assert cg.curve_order(a, b, 461) == cg._direct(a, b, 461)


@pytest.mark.parametrize("p", [1_000_003, 999_999_937, 2_147_483_647, 2_147_483_629])
def test_orders_over_large_fields(p):
    rng = random.Random(p)
    for _ in range(4):
        a, b = rng.randrange(p), rng.randrange(1, p)
        n = cg.curve_order(a, b, p)
        assert abs(n - p - 1) <= 2 * math.sqrt(p)
        for _ in range(8):
            x = rng.randrange(p)
            value = (x**3 + a * x + b) % p
            if value and pow(value, (p - 1) // 2, p) == 1:
                point = (x, cg._square_root(value, p))
                assert point[1] ** 2 % p == value and cg._times(p, a, point, n) is None


def test_supersingular_curves_have_p_plus_one_points():
    # p = 3 mod 4 with b = 0, and p = 2 mod 3 with a = 0
    assert cg.curve_order(7, 0, 2_147_483_647) == 2**31
    assert cg.curve_order(0, 11, 2_147_483_629 if 2_147_483_629 % 3 == 2 else 1_000_037) in (2_147_483_630, 1_000_038)


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, 1, 1_009), (1, 1, 1_009), (None, 1, 7), (1, 1, None), (1, 1, 2), (1, 1, 2**40), (0, 0, 11)]
    df = spark.createDataFrame(rows, "a long, b long, p long")
    got = {(r.a, r.b, r.p): r.n_points for r in cg.large_curve_orders(df).collect()}
    assert got == {(1, 1, 1_009): cg._direct(1, 1, 1_009), (1, 1, 2): None, (0, 0, 11): None}
    assert cg.large_curve_orders(df.limit(0)).collect() == []


def test_multiples_of_many_points_together_equal_those_of_each(monkeypatch):
    rng = random.Random(8)
    jobs = []
    for p in [1_009, 1_013, 999_999_937, 2_147_483_647] * 12:
        a, b, x = rng.randrange(p), rng.randrange(1, p), rng.randrange(p)
        value = (x**3 + a * x + b) % p
        if value and pow(value, (p - 1) // 2, p) == 1:
            jobs.append((p, a, (x, cg._square_root(value, p)), p + 1 - math.isqrt(4 * p), p + 1 + math.isqrt(4 * p)))
    alone = [cg._multiples(*job) for job in jobs]
    calls = []
    monkeypatch.setattr(cg, "_multiples", lambda *job, old=cg._multiples: calls.append(job) or old(*job))
    assert cg._multiples_of_all(jobs) == alone
    assert len(calls) < len(jobs) / 2
