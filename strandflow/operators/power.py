"""Detection power as dimension tables: each distinct (depth, fraction) is computed once and joined back."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_likelihood(depth, alts, eps: float, f):
    """log10 likelihood of ``alts`` among ``depth`` reads at error eps and alt fraction f."""
    with np.errstate(divide="ignore", invalid="ignore"):
        wrong, right = np.log10(f * eps + (1 - f) * (1 - eps)), np.log10(f * (1 - eps) + (1 - f) * eps)
        return (depth - alts) * wrong + alts * right


def binomial(n: int, p: float) -> np.ndarray:
    """P(k successes), k = 0..n, through log gamma."""
    k = np.arange(n + 1)
    if p <= 0 or p >= 1:
        return (k == (0 if p <= 0 else n)).astype(float)
    lg = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    return np.exp(lg[n] - lg - lg[::-1] + k * math.log(p) + (n - k) * math.log1p(-p))


def _tail(lod: np.ndarray, p: np.ndarray, threshold: float, smooth: bool) -> float:
    """Probability from the first count that reaches the threshold on; the bin before it counts in part."""
    reached = np.flatnonzero(lod >= threshold)
    if not len(reached):
        return 0.0
    k = int(reached[0])
    out = float(p[k:].sum())
    if smooth and k > 0:
        out += (1 - (threshold - lod[k - 1]) / (lod[k] - lod[k - 1])) * float(p[k - 1])
    return out


def tumor_power(depth: int, fraction: float, eps: float, threshold: float, contamination: float = 0.0, smooth: bool = True) -> float:
    if depth <= 0:
        return 0.0
    k = np.arange(depth + 1)
    f = k / depth
    lod = log_likelihood(depth, k, eps, f) - log_likelihood(depth, k, eps, np.minimum(f, contamination))
    return _tail(lod, binomial(depth, fraction * (1 - eps) + (1 - fraction) * eps), threshold, smooth)


def normal_power(depth: int, eps: float, threshold: float, smooth: bool = True) -> float:
    if depth <= 0:
        return 0.0
    alts = depth - np.arange(depth + 1)
    lod = log_likelihood(depth, alts, eps, 0.0) - log_likelihood(depth, alts, eps, 0.5)
    return _tail(lod, binomial(depth, eps)[::-1], threshold, smooth)


def with_power(df: DataFrame, kind: str, depth: str, out: str, eps: float, threshold: float, fraction: str | float | None = None, contamination: float = 0.0) -> DataFrame:
    """``df`` with the power of its (depth, fraction); only distinct pairs are computed, then joined."""
    pair = [depth] + ([fraction] if isinstance(fraction, str) else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b[fraction] if isinstance(fraction, str) else [fraction] * len(b)
            b[out] = [normal_power(int(n), eps, threshold) if kind == "normal" else tumor_power(int(n), float(x or 0), eps, threshold, contamination) for n, x in zip(b[depth], f, strict=True)]
            yield b

    keys = df.select(*pair).dropna().distinct()
    dim = keys.mapInPandas(run, ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in pair] + [f"`{out}` double"]))
    return df.join(dim, pair, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
