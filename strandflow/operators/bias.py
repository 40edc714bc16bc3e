"""Strand, position and quality bias statistics, vectorised over sites where they have closed forms."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: (depth, scale, shift) fitted to simulated reads of 100 bases
VDB_FIT = ((3, 0.079, 18), (4, 0.09, 19.8), (5, 0.1, 20.5), (6, 0.11, 21.5), (7, 0.125, 21.6), (8, 0.135, 22), (9, 0.14, 22.2), (10, 0.153, 22.3), (15, 0.19, 22.8), (20, 0.22, 23.2), (30, 0.26, 23.4), (40, 0.29, 23.5), (50, 0.35, 23.65), (100, 0.5, 23.7), (200, 0.7, 23.7))


def variant_distance_bias(histogram) -> float | None:
    """How evenly alternate bases spread over read positions (a histogram of 100 bins); null under two reads."""
    h = np.asarray(histogram, float)
    n = h.sum()
    if n < 2:
        return None
    at = np.arange(len(h))
    spread = float((h * np.abs(at - (h * at).sum() / n)).sum() / n)
    length = len(h)
    if n == 2:
        k = int(spread) + 1
        return (2 * length - 2 * k - 1) * k / (length - 1) / (length * 0.5)
    known = [d for d, *_ in VDB_FIT]
    i = int(np.searchsorted(known, n))
    if i >= len(known) or n >= known[-1]:
        _, scale, shift = VDB_FIT[-1]
    elif known[i] == n or i == 0:
        _, scale, shift = VDB_FIT[i]
    else:  # halfway between the neighbours
        scale, shift = ((VDB_FIT[i - 1][k] + VDB_FIT[i][k]) / 2 for k in (1, 2))
    return 0.5 * math.erfc(-(spread - shift) * scale)


@lru_cache(maxsize=None)
def _u_exact(n: int, m: int) -> tuple[float, ...]:
    """P(U = u), u = 0..n m, when n and m values are ordered at random."""
    if n == 0 or m == 0:
        return (1.0,)
    out = np.zeros(n * m + 1)
    a, b = _u_exact(n - 1, m), _u_exact(n, m - 1)
    out[m : m + len(a)] += n / (n + m) * np.array(a)
    out[: len(b)] += m / (n + m) * np.array(b)
    return tuple(out)


def _u(a, b) -> tuple[float, int, int]:
    a, b = np.asarray(a, float), np.asarray(b, float)
    below = np.cumsum(b) - b
    return float((a * (below + b / 2)).sum()), int(a.sum()), int(b.sum())


def mann_whitney(a, b) -> float | None:
    """Likelihood of the U statistic of two histograms over its mode: near 1 without bias, null if one is empty."""
    u, n, m = _u(a, b)
    if not n or not m:
        return None
    if n == 1 or m == 1:
        return 1.0
    mean = n * m / 2
    if n == 2 or m == 2:
        return (2 * mean - u) / mean if u > mean else u / mean
    var = n * m * (n + m + 1) / 12
    if n >= 8 or m >= 8:
        return math.exp(-0.5 * (u - mean) ** 2 / var)
    p = _u_exact(n, m)
    return p[int(u)] * math.sqrt(2 * math.pi * var)


def mann_whitney_cdf(a, b) -> float | None:
    """Two-sided P of the smaller U."""
    u, n, m = _u(a, b)
    if not n or not m:
        return None
    u = min(u, n * m - u)
    if n == 1 or m == 1:
        return 2.0 * (math.floor(u) + 1) / ((m if n == 1 else n) + 1)
    if n >= 8 or m >= 8:
        return 2.0 - math.erfc((u - n * m / 2) / math.sqrt(2 * n * m * (n + m + 1) / 12))
    return min(1.0, 2 * sum(_u_exact(n, m)[: int(u) + 1]))


def chi_square(a, b) -> float | None:
    """Q(df / 2, chi2 / 2) of two histograms by series or continued fraction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not a.sum() or not b.sum():
        return None
    use = (a + b) > 0
    x, s = float((((a - b) ** 2)[use] / (a + b)[use]).sum()) / 2, use.sum() / 2
    if x <= 0:
        return 1.0
    lead = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * lead
    tiny = 1e-300
    b0 = x + 1 - s
    c, d = 1 / tiny, 1 / b0
    h = d
    for i in range(1, 10000):
        an = -i * (i - s)
        b0 += 2
        d = 1 / (an * d + b0 or tiny)
        c = b0 + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * lead


def fisher_phred(a: int, b: int, c: int, d: int) -> int:
    """Two-sided Fisher test of a 2 x 2 table on the Phred scale, at most 255; 0 where a margin is under 2."""
    if min(a + b, c + d, a + c, b + d) < 2:
        return 0
    n, row, col = a + b + c + d, a + b, a + c
    lf = [math.lgamma(i + 1) for i in range(n + 1)]
    p = lambda x: math.exp(lf[row] + lf[n - row] + lf[col] + lf[n - col] - lf[n] - lf[x] - lf[row - x] - lf[col - x] - lf[n - row - col + x])
    own = p(a)
    total = sum(v for x in range(max(0, row + col - n), min(row, col) + 1) if (v := p(x)) <= own * (1 + 1e-7))
    return min(255, int(-4.343 * math.log(max(total, 1e-300)) + 0.499))


def binomial_ratio(n: int, p: float, k: int) -> float:
    """P(k) over P(int(n p)) of a binomial."""
    mean = int(n * p)
    lg = math.lgamma
    log_c = lambda x: lg(n + 1) - lg(x + 1) - lg(n - x + 1)
    return math.exp(log_c(k) - log_c(mean) + (k - mean) * (math.log(p) - math.log1p(-p)))


def inbreeding(nref: int, nalt: int, nhets: int, ndiploid: int) -> float | None:
    if not nref or not nalt or not ndiploid:
        return None
    q = 2 * nref * nalt / (nref + nalt) ** 2
    mean = q * ndiploid
    if (mean > 10 and (1 - q) * ndiploid > 10) or ndiploid > 200:
        return math.exp(-0.5 * (nhets - mean) ** 2 / (mean * (1 - q)))
    return binomial_ratio(ndiploid, q, nhets)


def heterozygote_bias(nref: Column, nalt: Column, nhets: Column, ndiploid: Column) -> Column:
    n = nref + nalt
    usable = (nref > 0) & (nalt > 0) & (ndiploid > 0)
    return F.when(usable, F.abs(F.try_divide(nhets, ndiploid) - F.try_divide(2 * nref * nalt, n * n)))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def segregation_bias(alts: Column, depths: Column) -> Column:
    """Poisson-mixture log ratio over samples: arrays of alternate and of all reads; null without alternates."""
    n = F.size(alts)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    nr = total(alts)
    mean_depth = F.floor(total(depths) / n)
    m = F.greatest(F.lit(1.0), F.least(F.floor(F.try_divide(nr, mean_depth) + 0.5), n.cast("double")))
    f, p, q = m / 2.0 / n, nr / n, nr / m

    def one(o: Column) -> Column:
        seen = log_sum_exp(F.ln(2 * (1 - f)), F.ln(f) + o * math.log(2.0) - q) + F.ln(f) + o * F.ln(q / p) - q + p
        none = F.ln(2 * f * (1 - f) * F.exp(-q) + f * f * F.exp(-2 * q) + (1 - f) * (1 - f)) + p
        return F.when(o > 0, seen).otherwise(none)

    return F.when(nr > 0, F.aggregate(alts, F.lit(0.0), lambda s, o: s + one(o)))


def _udf(f, kind=None):
    @F.pandas_udf(kind or T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def with_statistic(df, out: str, f, *columns: str):
    """``df`` with a double column of ``f`` over columns, in Arrow batches."""

    def run(batches):
        for b in batches:
            b[out] = pd.Series([f(*x) for x in zip(*[b[c] for c in columns], strict=True)], dtype="float64", index=b.index)
            yield b

    return df.mapInPandas(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{out}` double"]))


def mann_whitney_column(a: Column, b: Column, cdf: bool = False) -> Column:
    return _udf(mann_whitney_cdf if cdf else mann_whitney)(a, b)


def chi_square_column(a: Column, b: Column) -> Column:
    return _udf(chi_square)(a, b)


def vdb_column(histogram: Column) -> Column:
    return _udf(lambda h, _: variant_distance_bias(h))(histogram, histogram)


def fisher_column(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _udf(lambda x, y: fisher_phred(int(x[0]), int(x[1]), int(y[0]), int(y[1])))(F.array(a, b), F.array(c, d)).cast("int")


def inbreeding_column(nref: Column, nalt: Column, nhets: Column, ndiploid: Column) -> Column:
    return _udf(lambda x, y: inbreeding(int(x[0]), int(x[1]), int(y[0]), int(y[1])))(F.array(nref, nalt), F.array(nhets, ndiploid))
