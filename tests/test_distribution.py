import math
import random

import numpy as np
import pytest

from paceshift.operators.distribution import histogram, kernel_density


def sample(seed, n, mean):
    rng = random.Random(seed)
    return [round(rng.gauss(mean, 6), 3) for _ in range(n)]


def test_density_is_close_to_the_exact_sum(spark):
    data = {2022: sample(1, 400, 22), 2023: sample(2, 300, 18)}
    rows = [(y, v) for y, values in data.items() for v in values] + [(2023, None), (2023, 500.0)]
    out = kernel_density(spark.createDataFrame(rows, "year INT, v DOUBLE"), "v", 0.0, 60.0, ["year"]).collect()
    assert len(out) == 1024
    for year, values in data.items():
        values = np.array([v for v in values if 0 <= v <= 60])
        q1, q3 = np.quantile(values, [0.25, 0.75])
        bw = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
        curve = sorted((r.x, r.density, r.bw, r.n) for r in out if r.year == year)
        assert curve[0][2] == pytest.approx(bw) and curve[0][3] == len(values)
        x = np.array([c[0] for c in curve])
        exact = np.exp(-0.5 * ((x[:, None] - values) / bw) ** 2).mean(axis=1) / bw / math.sqrt(2 * math.pi)
        assert np.abs(np.array([c[1] for c in curve]) - exact).max() < 2e-4
        assert np.trapezoid([c[1] for c in curve], x) == pytest.approx(1.0, abs=0.02)


def test_density_goes_by_a_lattice_beyond_the_limits(spark):
    """As R does it: mass on 512 positions from four bandwidths below the lower limit to four above the upper one, smoothed there, then interpolated."""
    values = np.array(sample(4, 40, 30))
    out = sorted((r.i, r.density) for r in kernel_density(spark.createDataFrame([(1, v) for v in values.tolist()], "k INT, v DOUBLE"), "v", 0.0, 60.0, ["k"]).collect())
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    lattice = np.linspace(-4 * bw, 60 + 4 * bw, 512)
    at = (values - lattice[0]) / (lattice[1] - lattice[0])
    j = np.floor(at).astype(int)
    mass = (np.bincount(j, 1 - (at - j), 512) + np.bincount(j + 1, at - j, 512)) / len(values)
    smooth = (mass * np.exp(-0.5 * ((lattice[:, None] - lattice) / bw) ** 2)).sum(axis=1) / bw / math.sqrt(2 * math.pi)
    assert [d for _, d in out] == pytest.approx(np.interp(np.linspace(0, 60, 512), lattice, smooth), rel=1e-9, abs=1e-15)


def test_density_of_constant_and_single_values(spark):
    rows = [("same", 5.0)] * 4 + [("single", 7.0)]
    out = kernel_density(spark.createDataFrame(rows, "k STRING, v DOUBLE"), "v", 0.0, 10.0, ["k"]).collect()
    assert {r.k for r in out} == {"same"} and out[0].bw == pytest.approx(0.9 * 5.0 * 4**-0.2)


def test_density_result_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(1, v) for v in sample(3, 200, 20)], "k INT, v DOUBLE")
    a = [r.density for r in kernel_density(df.repartition(1), "v", 0.0, 60.0, ["k"]).orderBy("i").collect()]
    b = [r.density for r in kernel_density(df.repartition(7), "v", 0.0, 60.0, ["k"]).orderBy("i").collect()]
    assert a == pytest.approx(b, abs=1e-12)


def test_density_needs_a_key(spark):
    with pytest.raises(ValueError):
        kernel_density(spark.range(3), "id", 0.0, 1.0, [])


def test_histogram_bins_are_right_closed_and_edges_marked(spark):
    values = [0.0, 0.5, 0.50001, 1.5, 2.5, 119.5, 119.6, 120.0, 120.1, -0.1, None]
    out = histogram(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), "v", 0.0, 120.0)
    got = {r.bin: (r.n, r.is_edge) for r in out.collect()}
    assert got == {0.0: (2, True), 1.0: (2, False), 2.0: (1, False), 119.0: (1, False), 120.0: (2, True)}
