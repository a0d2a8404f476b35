"""Coefficient tables of L-functions, and SQL access with its declared profiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.plans import euler
from spectrafold.sources import tables
from spectrafold.sql import FUNCTIONS, SqlAccess

DATA = "/root/testdata/sf0.001"


def _points(spark, kmax=20):
    return spark.createDataFrame([("f", 1, 0.6, 14.1, kmax), ("g", 1, 0.6, 14.1, kmax)], "lfunc string, point_id long, sigma double, t double, kmax int")


def test_a_new_function_is_new_rows_and_leaves_others_alone(spark):
    primes = tables.prime_table(spark, 200)
    zeta = euler.constant_coefficients(primes, "f")
    other = primes.select(F.lit("g").alias("lfunc"), F.lit(2).alias("degree"), F.lit(None).cast("int").alias("modulus"), "p", (F.col("p") % 3 - 1.0).alias("coef"))
    alone = euler.lfunc_atlas(_points(spark).where("lfunc = 'f'"), euler.coefficient_table(zeta, primes), 30).collect()
    both = {r.lfunc: r for r in euler.lfunc_atlas(_points(spark), euler.coefficient_table(zeta.union(other), primes), 30).collect()}
    assert len(both) == 2 and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(alone[0][2:], both["f"][2:]))
    ps = [r.p for r in primes.orderBy("p").collect()][:20]
    z = np.array([p ** -(0.6 + 14.1j) for p in ps])
    c, p = np.array([x % 3 - 1.0 for x in ps]), np.array(ps, float)
    value = np.sum(np.log(p) * (c * z - 2 * p * z * z) / (1 - c * z + p * z * z))
    assert math.isclose(both["g"].V, -math.log(abs(value)), rel_tol=1e-9)
    assert both["f"].torus_xy == pytest.approx(both["g"].torus_xy)


def test_points_beyond_a_functions_rows_stop_the_job(spark):
    primes = tables.prime_table(spark, 200)
    zeta = euler.constant_coefficients(primes, "f")
    gap = zeta.where("p <> 11").select(F.lit("g").alias("lfunc"), "degree", "modulus", "p", "coef")
    table = euler.coefficient_table(zeta.union(gap), primes)
    with pytest.raises(Exception, match="above the table"):
        euler.lfunc_atlas(_points(spark), table, 30).collect()
    with pytest.raises(Exception, match="above the table"):
        euler.lfunc_atlas(_points(spark, 46).where("lfunc = 'f'"), table, 60).collect()
    assert euler.lfunc_atlas(_points(spark).limit(0), table, 30).collect() == []


def test_characters_and_curves_give_known_coefficients(spark):
    primes = tables.prime_table(spark, 60)
    values = spark.createDataFrame([("chi", 4, 1, 1.0), ("chi", 4, 3, -1.0), ("psi", 3, 1, 1.0), ("psi", 3, 2, -1.0)], "lfunc string, modulus int, residue int, coef double")
    rows = {(r.lfunc, r.p): r.coef for r in euler.character_rows(primes, values).collect()}
    assert rows["chi", 2] == 0 and rows["chi", 13] == 1 and rows["chi", 59] == -1 and rows["psi", 3] == 0 and rows["psi", 7] == 1 and len(rows) == 34
    curves = spark.createDataFrame([("e", -1, 1), ("same", -1, 1)], "lfunc string, a long, b long")
    got = {(r.lfunc, r.p): r.coef for r in euler.curve_rows(primes, curves).collect()}
    for p in (5, 7, 23, 59):
        count = sum((y * y - x**3 + x - 1) % p == 0 for x in range(p) for y in range(p))
        assert got["e", p] == got["same", p] == (0 if p == 23 else p - count)


def test_every_scalar_function_equals_its_formula(spark):
    access = SqlAccess(spark, DATA)
    got = access.sql("""SELECT magnitude(3, 4) AS a, decibel(0, 10) AS b, compactified(3) AS c, gauss_kuzmin(2) AS d, valuation2(48) AS e, neighbour_ratio(2, 8) AS f,
      near_harmonic(101, 50) AS g, near_harmonic(110, 50) AS h, discriminant_mod(-1, 1, 23) AS i, power_mod(3, 1000, 1009) AS j,
      prime_power_re(2, 0.5, 3) AS k, prime_power_im(2, 0.5, 3) AS l""").first()
    assert len(FUNCTIONS) == 11
    assert got.a == 5 and got.b == pytest.approx(20) and got.c == 0.75 and got.d == pytest.approx(-math.log2(1 - 1 / 9)) and got.e == 4 and got.f == pytest.approx(0.25)
    assert got.g and not got.h and got.i == 0 and got.j == pow(3, 1000, 1009)
    assert complex(got.k, got.l) == pytest.approx(2 ** -(0.5 + 3j))


def test_only_named_views_are_made_and_replaced_ones_feed_profiles(spark):
    access = SqlAccess(spark, "/no/such/folder")
    access.replace("series", spark.createDataFrame([(1, k, math.sin(k)) for k in range(64)] + [(2, k, 0.0) for k in range(64)], "series_id long, pos long, value double"))
    rows = access.sql("SELECT series_id, total_energy FROM cascade_profile").collect()
    assert {r.series_id for r in rows} == {1, 2} and access.made == {"series", "cascade_profile"}
    energy = {r.series_id: r.energy for r in access.sql("SELECT * FROM band_energy(0, 63)").collect()}
    assert energy[1] == pytest.approx(sum(math.sin(k) ** 2 for k in range(64))) and energy[2] == 0
    assert "cascade_profile" in access.names() and "euler_terms" in access.names()


def test_declared_profiles_keep_their_schema(spark):
    access = SqlAccess(spark, DATA)
    access.replace("series", spark.createDataFrame([(1, 0, 2.0), (2, 0, -3.0), (3, 0, None)], "series_id int, pos long, value double"))
    make = lambda spark, s: s.groupBy("series_id").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    access.declare("tops", make, ("series",), "series_id BIGINT, top DOUBLE", [(F.col("top") > 0, "HIGH", F.lit("top > 0"))], ("LOW", "else"))
    got = access.sql("SELECT * FROM tops")
    assert got.columns == ["series_id", "top", "verdict", "reason"] and dict(got.dtypes)["series_id"] == "bigint"
    assert {r.series_id: r.verdict for r in got.collect()} == {1: "HIGH", 2: "LOW", 3: "LOW"}
    for schema in ("series_id BIGINT, bottom DOUBLE", "series_id BIGINT, n INT", "series_id STRING"):
        access.declare("wrong", make, ("series",), schema)
        with pytest.raises(TypeError, match="wrong"):
            access.sql("SELECT * FROM wrong")
