"""Distribution tails for result rows (one per test, never per fact row).

All functions take numbers or numpy arrays and work on whole Arrow batches: a
series or continued fraction runs over a column until its last row has
converged. Wrapped as pandas UDFs for aggregated DataFrames; null or NaN in
any argument gives null.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-15
_TINY = 1e-300
_MOST_TERMS = 100_000
#: Largest sample for which the two-sample Kolmogorov-Smirnov tail is exact.
KS_EXACT_ROWS = 10_000


def _shaped(compute, *given):
    """``compute`` on flat float arrays of one length, in the shape of ``given`` (a float for plain numbers)."""
    arrays = np.broadcast_arrays(*[np.asarray(g, dtype=np.float64) for g in given])
    with np.errstate(all="ignore"):
        out = compute(*[a.ravel() for a in arrays])
    return float(out[0]) if arrays[0].ndim == 0 else out.reshape(arrays[0].shape)


def normal_sf(x: float) -> float:
    """P(Z > x) for a standard normal."""
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    """The standard normal quantile."""
    return NormalDist().inv_cdf(p)


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """log gamma(x) minus its leading Stirling terms, for x of at least 10."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: shifted to 10 and above, then Stirling's series."""
    x, factor = x.copy(), np.ones(len(x))
    while (low := x < 10).any():
        factor[low] *= x[low]
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + _stirling_rest(x) - np.log(factor)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the beta function, without cancellation where one argument is large."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    out = np.empty(len(a))
    far = large >= 10
    s, v = small[far], large[far]
    out[far] = _log_gamma(s) - (v - 0.5) * np.log1p(s / v) - s * np.log(s + v) + s + _stirling_rest(v) - _stirling_rest(s + v)
    s, v = small[~far], large[~far]
    out[~far] = _log_gamma(s) + _log_gamma(v) - _log_gamma(s + v)
    return out


def _away_from_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < _TINY, _TINY, x)


def _continued(first: np.ndarray, pairs) -> np.ndarray:
    """1 / (first + n1 / (d1 + n2 / (d2 + ...))) of every row; ``pairs(i, rows)`` gives the i-th (n, d) of those rows."""
    rows = np.arange(len(first))
    d = 1.0 / _away_from_zero(first)
    c, value = np.full(len(first), 1.0 / _TINY), d.copy()
    for i in range(1, _MOST_TERMS):
        if not len(rows):
            break
        n, b = pairs(i, rows)
        d = 1.0 / _away_from_zero(b + n * d)
        c = _away_from_zero(b + n / c)
        value[rows] *= d * c
        open_ = np.abs(d * c - 1) >= _EPS
        rows, d, c = rows[open_], d[open_], c[open_]
    return value


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(np.isnan(a + x), np.nan, 1.0)
    rows = np.flatnonzero((x > 0) & (a > 0))
    a, x = a[rows], x[rows]
    front = np.exp(a * np.log(x) - x - _log_gamma(a))
    far = a >= 10
    u = (x[far] - a[far]) / a[far]
    front[far] = np.exp(a[far] * (np.log1p(u) - u) + 0.5 * np.log(a[far] / (2 * math.pi)) - _stirling_rest(a[far]))
    tail = np.empty(len(rows))
    low = x < a + 1
    # below the mean: the power series of the other side
    al, xl = a[low], x[low]
    term = 1.0 / al
    total, live, k = term.copy(), np.arange(len(al)), 0
    while len(live) and k < _MOST_TERMS:
        k += 1
        term[live] *= xl[live] / (al[live] + k)
        total[live] += term[live]
        live = live[term[live] > total[live] * _EPS]
    tail[low] = 1.0 - front[low] * total
    ah, xh = a[~low], x[~low]
    tail[~low] = front[~low] * _continued(xh + 1 - ah, lambda i, r: (-i * (i - ah[r]), xh[r] + 2 * i + 1 - ah[r]))
    out[rows] = np.clip(tail, 0.0, 1.0)
    return out


def gamma_q(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    return _shaped(_gamma_q, a, x)


def chi2_sf(x, dof):
    """P(chi-squared with ``dof`` degrees of freedom > x)."""
    return _shaped(lambda v, k: _gamma_q(k / 2.0, v / 2.0), x, dof)


def _beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b), with y = 1 - x given apart so that neither side loses digits."""
    out = np.where(np.isnan(a + b + x), np.nan, np.where(x > 0, 1.0, 0.0))
    rows = np.flatnonzero((x > 0) & (y > 0))
    a, b, x, y = a[rows], b[rows], x[rows], y[rows]
    front = np.exp(a * np.log(x) + b * np.log(y) - _log_beta(a, b))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, y, x)

    def pair(i: int, r: np.ndarray) -> tuple[np.ndarray, float]:
        s, t, m = p[r], q[r], i // 2
        if i % 2:
            return -(s + m) * (s + t + m) * z[r] / ((s + 2 * m) * (s + 2 * m + 1)), 1.0
        return m * (t - m) * z[r] / ((s + 2 * m - 1) * (s + 2 * m)), 1.0

    part = front * _continued(np.ones(len(rows)), pair) / p
    out[rows] = np.clip(np.where(turn, 1.0 - part, part), 0.0, 1.0)
    return out


def beta_i(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    return _shaped(lambda s, t, v: _beta_i(s, t, v, 1.0 - v), a, b, x)


def _t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    square = t * t
    whole = dof + square
    finite = np.isfinite(square)
    x, y = np.where(finite, dof / whole, 0.0), np.where(finite, square / whole, 1.0)
    return np.where(np.isnan(t), np.nan, _beta_i(dof / 2.0, np.full(len(t), 0.5), x, y))


def t_two_sided(t, dof):
    """P(|T| > |t|) for Student's t."""
    return _shaped(_t_two_sided, t, dof)


def _t_ppf(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    target = 2 * np.minimum(p, 1 - p)  # two-sided tail of the quantile's size
    low, high = np.zeros(len(p)), np.ones(len(p))
    wide = np.flatnonzero((target > 0) & (dof > 0))
    while len(wide := wide[_t_two_sided(high[wide], dof[wide]) > target[wide]]):
        low[wide] = high[wide]
        high[wide] *= 2
    t = 0.5 * (low + high)
    rows = np.flatnonzero((target > 0) & (target < 1) & (dof > 0))
    log_density = -0.5 * np.log(dof) - _log_beta(dof / 2.0, np.full(len(p), 0.5))
    for _ in range(200):
        if not len(rows):
            break
        x, nu = t[rows], dof[rows]
        over = _t_two_sided(x, nu) - target[rows]
        low[rows] = np.where(over > 0, x, low[rows])
        high[rows] = np.where(over > 0, high[rows], x)
        slope = 2 * np.exp(log_density[rows] - (nu + 1) / 2 * np.log1p(x * x / nu))
        step = x + over / slope
        inside = (step > low[rows]) & (step < high[rows])  # else halve the bracket
        near = np.abs(step - x) <= 1e-14 * x
        t[rows] = np.where(near, x, np.where(inside, step, 0.5 * (low[rows] + high[rows])))
        rows = rows[~near]
    t = np.where(target == 0, np.inf, np.where(target >= 1, 0.0, t))
    return np.where(np.isnan(p + dof), np.nan, np.where(p < 0.5, -t, t))


def t_ppf(p, dof):
    """Student's t quantile: Newton steps that stay inside a bracket."""
    return _shaped(_t_ppf, p, dof)


def _kolmogorov_sf(lam: np.ndarray) -> np.ndarray:
    k = np.arange(1, 101)[:, None]
    total = 2.0 * ((2 * (k % 2) - 1) * np.exp(-2.0 * k * k * lam * lam)).sum(axis=0)
    return np.where(lam <= 0.2, 1.0, np.clip(total, 0.0, 1.0))  # below 0.2 the tail differs from 1 by less than 1e-12


def kolmogorov_sf(lam):
    """The limiting two-sided Kolmogorov tail."""
    return _shaped(_kolmogorov_sf, lam)


def _ks_exact(n: int, m: int, reach: int) -> float:
    """P(some |i m - j n| >= reach) over all orders of n and m values, i and j of which are seen.

    The orders are lattice paths from (0, 0) to (n, m). The share of paths that
    have touched the border is carried along the diagonals i + j = k: only
    sums of positive terms, so small tails keep their digits.
    """
    touched = np.ones(n + 2)  # at i + 1; 1 outside the border
    touched[1] = 0.0 if reach > 0 else 1.0
    last = 0
    both = n + m
    for k in range(1, both + 1):
        low = max((k * n - reach) // both + 1, 0, k - m)
        high = min(-(-(k * n + reach) // both) - 1, k, n)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        inside = (i * touched[low : high + 1] + (k - i) * touched[low + 1 : high + 2]) / k
        touched[last + 1 : low + 1] = 1.0
        touched[low + 1 : high + 2] = inside
        last = low
    return float(touched[n + 1])


def _ks_two_sample(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    effective = n * m / (n + m)
    root = np.sqrt(effective)
    lam = root * distance
    out = _kolmogorov_sf(lam + 1 / (6 * root) + (lam - 1) / (4 * effective))
    out = np.where(np.isnan(n + m + distance), np.nan, out)
    known: dict[tuple[int, int, int], float] = {}
    for row in np.flatnonzero((np.maximum(n, m) <= KS_EXACT_ROWS) & ~np.isnan(distance)):
        a, b = sorted((int(n[row]), int(m[row])))
        case = a, b, round(float(distance[row]) * a * b)
        if case not in known:
            known[case] = _ks_exact(*case)
        out[row] = known[case]
    return out


def ks_two_sample_sf(n, m, distance):
    """P(D >= distance) of two samples of n and m values from one continuous distribution.

    Exact up to ``KS_EXACT_ROWS`` values a sample; above, the limiting tail at
    a distance corrected for the finite effective size (the one-sample form).
    At that border it is within 2 % of the exact tail near 0.05: the lattice of
    possible distances, coarsest for equal sizes, is not in the correction.
    """
    return _shaped(_ks_two_sample, n, m, distance)


def _series(fn, *columns: pd.Series) -> pd.Series:
    """``fn`` over columns; null where an argument is null or NaN."""
    arrays = [c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]
    known = ~np.isnan(arrays).any(axis=0)
    out = pd.Series([None] * len(known), dtype="Float64")
    if known.any():
        out[known] = fn(*[a[known] for a in arrays])
    return out


@pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(chi2_sf, x, dof)


@pandas_udf(DoubleType())
def t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, dof)


@pandas_udf(DoubleType())
def t_ppf_udf(p: pd.Series, dof: pd.Series) -> pd.Series:
    def each(prob: np.ndarray, nu: np.ndarray) -> np.ndarray:
        cases, at = np.unique(np.column_stack([prob, nu]), axis=0, return_inverse=True)
        return t_ppf(cases[:, 0], cases[:, 1])[at.ravel()]

    return _series(each, p, dof)


@pandas_udf(DoubleType())
def ks_two_sample_sf_udf(n: pd.Series, m: pd.Series, distance: pd.Series) -> pd.Series:
    return _series(ks_two_sample_sf, n, m, distance)


@pandas_udf(DoubleType())
def normal_two_sided_udf(z: pd.Series) -> pd.Series:
    return _series(lambda v: 2.0 * np.vectorize(normal_sf, otypes=[float])(np.abs(v)), z)
