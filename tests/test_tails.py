"""Distribution tails against published critical values."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from spendwright.functions import tails as T


@pytest.mark.parametrize(
    "x, dof, p",
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (6.634897, 1, 0.01)],
)
def test_chi2_critical_values(x, dof, p):
    assert T.chi2_sf(x, dof) == pytest.approx(p, abs=1e-6)


def test_chi2_edges():
    assert T.chi2_sf(0, 3) == 1.0
    assert T.chi2_sf(10, 2) == pytest.approx(math.exp(-5), rel=1e-12)


@pytest.mark.parametrize("t, dof", [(12.706205, 1), (2.228139, 10), (2.042272, 30), (1.983972, 100)])
def test_t_critical_values(t, dof):
    assert T.t_two_sided(t, dof) == pytest.approx(0.05, abs=1e-6)
    assert T.t_ppf(0.975, dof) == pytest.approx(t, abs=1e-5)
    assert T.t_ppf(0.025, dof) == pytest.approx(-t, abs=1e-5)


def test_normal():
    assert T.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert 2 * T.normal_sf(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_columns_equal_single_values_and_hard_cases():
    x, dof = np.array([0.0, 0.5, 3.0, 50.0, 900.0, 1e5]), np.array([1.0, 2.0, 7.0, 40.0, 1000.0, 1e5])
    assert T.chi2_sf(x, dof) == pytest.approx([T.chi2_sf(float(a), float(b)) for a, b in zip(x, dof)], rel=1e-14)
    assert T.chi2_sf(1e5, 1e5) == pytest.approx(0.4994, abs=1e-4)  # the mean of a wide chi-squared
    assert T.t_two_sided(0.0, 5) == 1.0 and T.t_two_sided(float("inf"), 5) == 0.0
    t = np.array([1e-9, 0.3, 2.0, 40.0, 1e6])
    # one and two degrees of freedom have closed forms
    assert T.t_two_sided(t, 1.0) == pytest.approx(1 - 2 / math.pi * np.arctan(t), rel=1e-9)
    assert T.t_two_sided(t, 2.0) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-4)
    assert T.t_two_sided(1.959964, 1e9) == pytest.approx(0.05, abs=1e-7)


def test_t_quantile_inverts_the_tail():
    p = np.repeat([1e-12, 0.001, 0.3, 0.5, 0.7, 0.975, 0.9999], 5)
    dof = np.tile([1.0, 2.0, 5.0, 117.0, 1e6], 7)
    q = T.t_ppf(p, dof)
    assert T.t_two_sided(q, dof) == pytest.approx(2 * np.minimum(p, 1 - p), rel=1e-9)
    assert (np.sign(q) == np.sign(p - 0.5)).all()
    assert T.t_ppf(0.75, 1.0) == pytest.approx(1.0, rel=1e-12)


def test_nulls_stay_null():
    found = T._series(T.chi2_sf, pd.Series([1.0, None, np.nan, 3.841459]), pd.Series([1.0, 1.0, 1.0, 1.0]))
    assert found.isna().tolist() == [False, True, True, False] and found[3] == pytest.approx(0.05, abs=1e-6)
    assert len(T._series(T.chi2_sf, pd.Series([], dtype=float), pd.Series([], dtype=float))) == 0


@pytest.mark.parametrize("n, m", [(1, 1), (2, 5), (4, 4), (6, 3), (5, 7)])
def test_exact_ks_equals_all_orders(n, m):
    """Every order of n and m values, counted one by one."""
    distances = []
    for chosen in combinations(range(n + m), n):
        i = np.cumsum([k in chosen for k in range(n + m)])
        j = np.arange(1, n + m + 1) - i
        distances.append(int(np.abs(i * m - j * n).max()))
    for reach in range(n * m + 2):
        share = sum(d >= reach for d in distances) / len(distances)
        assert T.ks_two_sample_sf(n, m, reach / (n * m)) == pytest.approx(share, abs=1e-12)


def test_exact_ks_published_and_large():
    # published two-sided values for equal samples: P(D >= h / n)
    assert T.ks_two_sample_sf(5, 5, 0.8) == pytest.approx(20 / 252, rel=1e-12)
    assert T.ks_two_sample_sf(10, 10, 0.6) == pytest.approx(0.052447552, abs=1e-8)
    assert T.ks_two_sample_sf(8, 8, 1.0) == pytest.approx(2 / math.comb(16, 8), rel=1e-12)
    # a tail far below 1e-16 keeps its digits: all of one sample before the other
    assert T.ks_two_sample_sf(40, 60, 1.0) == pytest.approx(2 / math.comb(100, 40), rel=1e-10)
    # exact and corrected tails meet at the border, and the limit alone would not
    exact, above = T.ks_two_sample_sf(10_000, 10_000, 0.0193), T.ks_two_sample_sf(10_001, 10_000, 0.0193)
    assert above == pytest.approx(exact, rel=0.02)
    exact, above = T.ks_two_sample_sf(10_000, 9_973, 0.0193), T.ks_two_sample_sf(10_001, 9_973, 0.0193)
    assert above == pytest.approx(exact, rel=0.01)
    small = T.ks_two_sample_sf(10, 12, 0.5)
    assert abs(small - T.kolmogorov_sf(math.sqrt(120 / 22) * 0.5)) > 0.01


def test_kolmogorov():
    assert T.kolmogorov_sf(1.358099) == pytest.approx(0.05, abs=1e-5)
    assert T.kolmogorov_sf(1.627624) == pytest.approx(0.01, abs=1e-5)
    assert T.kolmogorov_sf(0.0) == 1.0
