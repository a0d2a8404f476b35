import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions.fixed import ZETA_ZEROS
from spectrafold.operators import fourier, graphs, quotients, wavelet
from spectrafold.plans import cascade, colour, curves, dispersion, euler, graph, levels, quotient
from spectrafold.sources import tables


def test_valleys_lead_to_the_first_ten_zeros(spark):
    grid = spark.range(1200).select(F.col("id").alias("pos"), (F.col("id") * 0.05).alias("t"))
    valleys = euler.valley_scan(grid)
    assert valleys.count() == 14
    found = sorted(r.gamma for r in euler.valley_refine(valleys).where("accepted AND gamma > 10 AND gamma < 50").collect())
    assert np.allclose(found, ZETA_ZEROS, atol=1e-5)
    with pytest.raises(NotImplementedError):
        euler.valley_scan(grid, lfunc="dirichlet")


def test_scan_far_up_finds_every_zero(spark):
    """Between 1,050 and 1,080 the counting formula has 25 or 26 zeros; 80 terms would not do there."""
    count = lambda t: t / (2 * math.pi) * math.log(t / (2 * math.pi * math.e)) + 7 / 8
    grid = spark.range(600).select(F.col("id").alias("pos"), (1050 + F.col("id") * 0.05).alias("t"))
    got = euler.valley_refine(euler.valley_scan(grid)).where("accepted").count()
    assert abs(got - (count(1080) - count(1050))) < 1.5


def test_the_main_sum_equals_long_sums(spark):
    """Against the accelerated series up to 400, and a long plain sum averaged over its last two partial sums beyond."""
    ts = [81.3, 150.0, 250.77, 399.9, 2 * math.pi * 5.25**2, 2 * math.pi * 40.75**2, 1000.0, 10_000.5, 100_000.25]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ts)], "pos long, t double")
    got = {r.pos: r.eta for r in euler.eta_scan(rows).collect()}
    for k, t in enumerate(ts):
        n = np.arange(1, int(40 * t) + 2)
        z = np.where(n % 2, 1, -1) * n**-0.5 * np.exp(-1j * t * np.log(n))
        total = z.cumsum()[-12:]
        while len(total) > 1:
            total = (total[1:] + total[:-1]) / 2
        assert abs(got[k] - abs(total[0])) < (1e-3 if t < 1000 else 2e-4), t


def test_large_numbers_are_tested_for_primality(spark):
    primes = [2, 37, 999_983, 1_000_003, 2**31 - 1, 2**61 - 1, 4_611_686_018_427_387_847]
    others = [-7, 0, 1, 4, 999_983 * 2, 1_000_003 * 1_000_033, 3_215_031_751, 3_825_123_056_546_413_051, 2**62, 2_147_483_647**2]
    rows = spark.createDataFrame([(n,) for n in primes + others], "n long")
    got = {r.n for r in rows.where(tables.is_prime("n")).collect()}
    assert got == set(primes)


def test_continued_fraction_of_a_rational(spark):
    df = spark.createDataFrame([(1, 355, 113), (2, 144, 89), (3, -7, 3)], "seq_id long, num long, den long")
    rows = quotients.expand_rationals(df).orderBy("seq_id", "k").collect()
    assert [(r.a, r.q) for r in rows if r.seq_id == 1] == [(3, 1), (7, 7), (16, 113)]
    assert [r.a for r in rows if r.seq_id == 2] == [1] * 9 + [2]
    assert [r.a for r in rows if r.seq_id == 3] == [-3, 1, 2]
    profile = {r.seq_id: r for r in quotient.cf_profile(quotients.expand_rationals(df)).collect()}
    assert profile[1].levy_exponent is None and profile[2].run_length_1 == 8.0


def test_gauss_kuzmin_shares():
    bins, residues = quotient.reference_shares()
    assert abs(bins[0] - math.log2(4 / 3)) < 1e-12
    assert np.allclose(residues, [0.177868, 0.548495, 0.273637], atol=1e-6)


def test_curve_orders_and_verdicts(spark):
    df = spark.createDataFrame(
        [("secure", 3, 2, 127), ("smooth", 2, 3, 101), ("anomalous", 0, 5, 7), ("mov", 0, 1, 83), ("zero", 1, 0, 79)],
        "curve_id string, a long, b long, p long",
    )
    rows = {r.curve_id: r for r in curves.curve_audit(df).collect()}
    assert {k: int(r.order) for k, r in rows.items()} == {"secure": 139, "smooth": 96, "anomalous": 7, "mov": 84, "zero": 80}
    assert rows["secure"].verdict == "SECURE" and rows["secure"].embedding_degree == 69
    assert rows["smooth"].verdict in ("POHLIG_HELLMAN", "WEAK") and rows["anomalous"].verdict in ("ANOMALOUS", "WEAK")
    assert rows["mov"].verdict in ("MOV_WEAK", "WEAK") and rows["zero"].verdict in ("MOV_WEAK", "WEAK", "ANOMALOUS")


def _numpy_haar(x, levels):
    out = []
    for _ in range(levels):
        if len(x) < 2:
            break
        if len(x) % 2:
            x = np.append(x, 0.0)
        out.append((x[0::2] - x[1::2]) / math.sqrt(2))
        x = (x[0::2] + x[1::2]) / math.sqrt(2)
    return out, x


@pytest.mark.parametrize("n", [5, 16, 37])
def test_haar_matches_the_recursive_form_and_keeps_energy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, pos long, value double")
    rows = wavelet.haar_1d(df, 4).collect()
    details, approx = _numpy_haar(x, 4)
    for level, want in enumerate(details, 1):
        got = [r.coef for r in sorted((r for r in rows if r.level == level), key=lambda r: r.pos)]
        assert np.allclose(got, want)
    assert np.allclose([r.coef for r in sorted((r for r in rows if r.level == 0), key=lambda r: r.pos)], approx)
    assert abs(sum(r.coef**2 for r in rows) - float(x @ x)) < 1e-9


@pytest.mark.parametrize("n", [7, 12, 64])
def test_dft_matches_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "g string, pos long, v double")
    got = {r.bin: complex(r.re, r.im) for r in fourier.dft(df, ["g"], "pos", "v", n).collect()}
    assert np.allclose([got[k] for k in range(n)], np.fft.fft(x))


def test_power_2d_matches_numpy(spark):
    v = np.random.default_rng(0).normal(size=(6, 8))
    df = spark.createDataFrame([("i", y, x, float(v[y, x])) for y in range(6) for x in range(8)], "g string, y int, x int, v double")
    want = np.abs(np.fft.fftshift(np.fft.fft2(v - v.mean()))) ** 2
    for r in fourier.power_2d(df, ["g"], 6, 8).collect():
        assert abs(want[r.fy + 3, r.fx + 4] - r.power) < 1e-9


def test_cascade_edge_cases(spark):
    rows = [("flat", i, 1.0) for i in range(16)] + [("zero", i, 0.0) for i in range(8)] + [("one", 0, 3.0)]
    t = np.arange(256)
    rows += [("burst", int(i), float(1e-3 * np.sin(i) + (50 if i == 100 else 0))) for i in t]
    df = spark.createDataFrame(rows, "series_id string, pos long, value double")
    got = {r.series_id: r for r in cascade.cascade_profile(df).collect()}
    assert got["burst"].verdict == "INTERMITTENT"
    assert got["flat"].total_energy < 1e-20 and got["flat"].status == "ok"
    assert "one" not in got or got["one"].verdict is None
    assert cascade.cascade_profile(df.limit(0)).count() == 0


def test_rectangle_levels(spark):
    h = 1.4 / 34
    line = [2 * (1 - math.cos(math.pi * k / 24)) / h**2 for k in range(1, 24)]
    values = sorted(a + b for a in line for b in line)[:20]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "obj_id string, idx int, level double")
    row = levels.level_profile(df).first()
    assert row.n_modes == 20 and abs(row.f_0 - values[0]) < 1e-12 and row.degeneracy >= 5 and row.non_degen == 0.0
    assert levels.level_profile(df.where("idx < 2")).first().f_0 is None


def test_one_atom_band_is_flat_and_two_atoms_match_closed_form(spark):
    df = spark.createDataFrame([(1, [28.0], [80.0]), (2, [28.0, 12.0], [80.0, 65.0])], "mat_id long, masses array<double>, springs array<double>")
    bands = dispersion.chain_bands(df).collect()
    assert len({round(r.omega, 12) for r in bands if r.mat_id == 1}) == 1
    for r in bands:
        if r.mat_id == 2 and r.q_idx == 7:
            m = np.array([[145 / 28, 0], [0, 145 / 12]], complex)
            m[1, 0] = -(65 + 80 * np.exp(-1j * r.q)) / math.sqrt(28 * 12)
            assert abs(np.linalg.eigvalsh(m)[r.branch] - r.omega**2) < 1e-9


def test_prime_table(spark):
    small = [r.p for r in tables.prime_table(spark, 1500).orderBy("k").collect()]
    assert len(small) == 239 and small[:5] == [2, 3, 5, 7, 11]
    assert tables.prime_table(spark, 30_000).count() == 3245


def test_colour_profile_needs_41_points(spark):
    rows = [("a", i, 380.0 + 10 * i, float(1 + (i == 20))) for i in range(41)] + [("b", i, 380.0 + 10 * i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, idx int, nm double, amp double")
    got = {r.series_id: r for r in colour.color_profile(df, colour.observer_table(spark)).collect()}
    assert got["a"].peak_wl == 580.0 and got["a"].n_peaks == 1.0 and got["b"].X is None


def _path_and_star(spark):
    rows = [("path", i, i + 1) for i in range(9)] + [("star", 0, i) for i in range(1, 8)] + [("two", 0, 1), ("two", 2, 3), ("two", 3, 2), ("two", 5, 5)]
    return tables.edge_table(spark.createDataFrame(rows, "g string, a long, b long"), "g", "a", "b")


def test_graph_operators_on_known_graphs(spark):
    edges = graphs.checkpointed(_path_and_star(spark))
    assert edges.where("graph_id = 'two'").count() == 4
    parts = {(r.graph_id, r.node): r.component for r in graphs.connected_components(edges).collect()}
    assert {parts["two", n] for n in (0, 1, 2, 3)} == {0, 2} and {v for (g, _), v in parts.items() if g == "path"} == {0}
    start = spark.createDataFrame([("path", 0)], "graph_id string, source long")
    assert {r.node: r.dist for r in graphs.bfs_distances(edges, start).collect()} == {i: i for i in range(10)}
    pairs = spark.createDataFrame([("path", 0, 9), ("star", 1, 2)], "graph_id string, a long, b long")
    got = {r.graph_id: r.resistance for r in graphs.effective_resistance(edges, pairs).collect()}
    assert abs(got["path"] - 9) < 1e-6 and abs(got["star"] - 2) < 1e-6


def test_laplacian_modes_of_path_and_star(spark):
    edges = graphs.checkpointed(_path_and_star(spark))
    spectrum, vectors = graphs.laplacian_modes(edges)
    rows = {r.graph_id: r for r in spectrum.collect()}
    path = [2 - 2 * math.cos(math.pi * k / 10) for k in range(1, 10)]
    assert len(rows["path"]["values"]) >= 3 and np.allclose(rows["path"]["values"], path[: len(rows["path"]["values"])], atol=1e-6)
    assert np.allclose(rows["star"]["values"], [1.0] * 6 + [8.0], atol=1e-8) and rows["star"].complete
    assert rows["two"]["values"][0] < 1e-9
    side = {r.node: r.modes[0] for r in vectors.where("graph_id = 'path'").collect()}
    assert all(side[i] * side[9 - i] < 0 for i in range(5))


def _dense_graph_features(n, pairs, modes=20):
    """Spectrum and the columns that rest on it, from the dense Laplacian."""
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    degree = a.sum(axis=1)
    values, vectors = np.linalg.eigh(np.diag(degree) - a)
    low = np.maximum(values[:modes], 0)
    positive, fiedler, mean = low[low > 1e-10], vectors[:, 1], degree.mean()
    cut = np.mean([fiedler[i] * fiedler[j] < 0 for i, j in pairs])
    share = positive / positive.sum()
    return low, {
        "n_eigs": len(low), "algebraic_conn": low[1], "spectral_radius": low[-1], "hub_dominance": low[-1] / mean,
        "bipartiteness": abs(low[-1] - 2 * mean) / mean, "spectral_entropy": -np.sum(share * np.log(share)), "cut_ratio": cut,
        "eff_resistance": min(n * np.sum(1 / positive), 1e6) / n**2, "mean_spacing": np.diff(low[1:]).mean(),
    }


def test_graph_profile_rests_on_the_twenty_lowest_modes_of_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    random_pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, 90, (420, 2)) if i < j} | {(i, i + 1) for i in range(89)})
    shapes = {
        "random": (90, random_pairs), "path": (40, [(i, i + 1) for i in range(39)]), "wheel": (21, [(0, i) for i in range(1, 21)] + [(i, i + 1) for i in range(1, 20)]),
        "small": (5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2)]),
    }
    rows = [(g, u, v) for g, (_, pairs) in shapes.items() for i, j in pairs for u, v in ((i, j), (j, i))]
    edges = graphs.checkpointed(spark.createDataFrame(rows, "graph_id string, src long, dst long"))
    spectrum = {r.graph_id: r for r in graphs.laplacian_modes(edges)[0].collect()}
    profile = {r.graph_id: r for r in graph.graph_profile(edges).collect()}
    assert set(profile) == set(shapes)
    for g, (n, pairs) in shapes.items():
        values, features = _dense_graph_features(n, pairs)
        assert np.allclose(spectrum[g]["values"], values[1:], atol=1e-6), g
        assert spectrum[g].complete == (n <= 20)
        for name, want in features.items():
            assert abs(profile[g][name] - want) < 1e-5, (g, name)


def test_resistance_stays_in_the_component_and_is_null_across(spark):
    edges = graphs.checkpointed(_path_and_star(spark))
    pairs = spark.createDataFrame([("two", 0, 1), ("two", 0, 3), ("two", 2, 3)], "graph_id string, a long, b long")
    got = {(r.a, r.b): r.resistance for r in graphs.effective_resistance(edges, pairs).collect()}
    assert abs(got[0, 1] - 1) < 1e-6 and abs(got[2, 3] - 1) < 1e-6 and got[0, 3] is None
    with pytest.raises(RuntimeError):
        graphs.effective_resistance(edges, spark.createDataFrame([("path", 0, 9)], pairs.schema), max_steps=2)
