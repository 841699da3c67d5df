"""Tail probabilities in numpy, vectorised, accurate far into the tails."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x):
    """log of the gamma function for x > 0: Stirling's series from 10 on, reached by the recurrence from below."""
    x = np.asarray(x, float)
    low = x < 10
    near = np.where(low, x, 1.0)
    down = np.log(near * (near + 1) * (near + 2) * (near + 3) * (near + 4)) + np.log((near + 5) * (near + 6) * (near + 7) * (near + 8) * (near + 9))
    z = np.where(low, near + 10, x)
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.where(low, down, 0.0)


_lgamma = lgamma


def _beta_fraction(a, b, x):
    """Lentz's continued fraction for the incomplete beta integral."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def betainc(a, b, x, y=None):
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where that is known better."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    y = 1 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (y > 0)
    if inside.any():
        a, b, x, y = a[inside], b[inside], x[inside], y[inside]
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log(y))
        low = x < (a + 1) / (a + b + 2)
        value = np.empty_like(x)
        if low.any():
            value[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
        if (~low).any():
            value[~low] = 1 - front[~low] * _beta_fraction(b[~low], a[~low], y[~low]) / b[~low]
        out = out.copy()
        out[inside] = value
    return out


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    return betainc(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_tail(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_tail(x, df):
    """Upper tail: series below df + 2, continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, x / 2
    out = np.ones_like(z)
    for i in np.ndindex(z.shape):
        s, v = a[i], z[i]
        if v <= 0:
            continue
        front = math.exp(-v + s * math.log(v) - math.lgamma(s))
        if v < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > abs(total) * 1e-17:
                k += 1
                term *= v / k
                total += term
            out[i] = 1 - total * front
        else:
            b, c = v + 1 - s, 1e300
            d = 1 / b
            h = d
            for k in range(1, 10_000):
                n = -k * (k - s)
                b += 2
                d = 1 / (n * d + b or 1e-300)
                c = b + n / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = front * h
    return out


def normal_two_sided(z):
    return np.vectorize(math.erfc, otypes=[float])(np.abs(np.asarray(z, float)) / math.sqrt(2))


def fisher_two_sided(a, b, c, d):
    """p of the 2x2 table, summing all tables that are no likelier."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    k = np.arange(lo, hi + 1, dtype=float)
    g = _lgamma
    logs = -(g(k + 1) + g(row - k + 1) + g(col - k + 1) + g(n - row - col + k + 1))
    pmf = np.exp(logs - logs.max())
    return float(min(1.0, pmf[pmf <= pmf[int(a - lo)] * (1 + 1e-7)].sum() / pmf.sum()))


def digamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def ks_two_sample(d: float, n1: int, n2: int) -> float:
    """Two-sided p of a two-sample distance: exact while n1 * n2 is at most ten million, else the asymptotic series.

    The exact value is the share of lattice paths from (0, 0) to (n1, n2) that reach the distance, row by row.
    """
    if d <= 0:
        return 1.0
    if n1 * n2 > 10_000_000:
        x = d * math.sqrt(n1 * n2 / (n1 + n2))
        k = np.arange(1, 101)
        return float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * x) ** 2)).sum(), 0, 1))
    n1, n2 = min(n1, n2), max(n1, n2)
    limit = (d - 1e-7) * n1 * n2
    inside = lambda i: np.abs(i * n2 - np.arange(n2 + 1) * n1) < limit
    # share[j]: of the paths to (i, j), those that stay inside; steps weigh by their share of all paths there
    share = np.cumprod(inside(0)).astype(float)
    j = np.arange(n2 + 1)
    for i in range(1, n1 + 1):
        own, ok = np.empty(n2 + 1), inside(i)
        own[0] = share[0] * ok[0]
        left, down = j / (i + j), i / (i + j) * share
        for k in range(1, n2 + 1):
            own[k] = (own[k - 1] * left[k] + down[k]) if ok[k] else 0.0
        share = own
    return float(np.clip(1 - share[n2], 0, 1))


def kendall_exact(s: float, n: int) -> float:
    """Two-sided exact p of Kendall's S (concordant less discordant pairs) without ties, from the inversion counts."""
    counts = np.ones(1)
    for k in range(2, n + 1):
        counts = np.convolve(counts, np.ones(k)) / k
    pairs = n * (n - 1) // 2
    low = int(min((pairs - abs(s)) / 2, pairs))
    return float(min(1.0, 2 * counts[: low + 1].sum()))
