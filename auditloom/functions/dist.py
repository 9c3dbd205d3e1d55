"""Distribution tails in plain Python, usable on executors: normal, t, F, chi-square, noncentral t, hypergeometric."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _invert(norm_cdf, p, -40.0, 40.0)


def _invert(cdf, p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
        if high - low <= 1e-14 * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 2.0
    while t_cdf(high, df) < p and high < 1e12:
        high *= 2
    return _invert(lambda x: t_cdf(x, df), p, 0.0, high)


def t_two_sided(x: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + x * x))


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(320)
_ERFC = np.frompyfunc(math.erfc, 1, 1)


def nct_cdf(x: float, df: float, ncp: float) -> float:
    """Noncentral t: the normal tail of a scaled chi, integrated over the logarithm of the chi by Gauss's rule."""
    if df > 1e6:
        return norm_cdf(x - ncp)
    # P(T <= x) = E[ Phi(x * s - ncp) ], s = sqrt(V / df), V chi-square with df
    log_c = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
    spread = 1 / math.sqrt(2 * df)
    low, high = -12 * spread - 18 / df, min(6.0, 10 * spread + 2 / df)
    u = (high - low) / 2 * _NODES + (high + low) / 2
    dens = np.exp(log_c + df * u - (df / 2) * np.exp(2 * u))
    phi = 0.5 * _ERFC(-(x * np.exp(u) - ncp) / math.sqrt(2)).astype(float)
    return float(min(1.0, max(0.0, (high - low) / 2 * np.sum(_WEIGHTS * dens * phi))))


def hypergeom_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fixed-margin p of a 2 x 2 table: the tables no likelier than this one."""
    r1, r2, c1 = a + b, c + d, a + c
    log_comb = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    whole = log_comb(r1 + r2, c1)
    logs = [log_comb(r1, k) + log_comb(r2, c1 - k) - whole for k in range(max(0, c1 - r2), min(r1, c1) + 1)]
    own = log_comb(r1, a) + log_comb(r2, c) - whole
    return min(1.0, math.fsum(math.exp(v) for v in logs if v <= own + 1e-7))


#: Cells of the exact distributions; beyond, their normal approximation is exact enough and the only one that can be computed.
MAX_CELLS = 10_000_000


def mann_whitney_exact(u: float, na: int, nb: int) -> float:
    """Two-sided p of U without ties: the coefficients of the Gaussian binomial count the orders."""
    m, n = sorted((na, nb))
    w = np.zeros(m * n + 1)
    w[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= m * n:
            w[n + i :] -= w[: -(n + i)].copy()
        for r in range(min(i, len(w))):
            w[r::i] = np.cumsum(w[r::i])
    top = math.ceil(max(u, m * n - u) - 1e-9)
    return float(min(1.0, 2 * w[top:].sum() / w.sum()))


def wilcoxon_exact(w_plus: float, n: int) -> float:
    """Two-sided p of the signed rank sum without ties and zeros: every sign is as likely."""
    f = np.zeros(n * (n + 1) // 2 + 1)
    f[0] = 1.0
    for i in range(1, n + 1):
        f[i:] = f[i:] + f[:-i].copy()
    low = math.floor(min(w_plus, n * (n + 1) / 2 - w_plus) + 1e-9)
    return float(min(1.0, 2 * f[: low + 1].sum() / f.sum()))
