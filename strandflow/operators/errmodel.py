"""The revised MAQ error model: genotype likelihoods of dependent sequencing errors (published formulas)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

DEPENDENCY, FLOOR, MOST = 0.83, 0.03, 255


@lru_cache(maxsize=1)
def _log_choose() -> np.ndarray:
    lg = np.array([math.lgamma(i + 1) for i in range(MOST + 1)])
    n = np.arange(MOST + 1)
    with np.errstate(invalid="ignore"):
        return lg[:, None] - lg[None, :] - np.where(n[:, None] >= n[None, :], lg[np.maximum(n[:, None] - n[None, :], 0)], np.inf)


@lru_cache(maxsize=512)
def _beta(q: int, n: int) -> np.ndarray:
    """Phred cost of the k-th error among n bases of quality q: the conditional tail ratio P(>= k+1) / P(>= k)."""
    e = 10.0 ** (-q / 10)
    k = np.arange(n + 1)
    logs = _log_choose()[n, : n + 1] + k * math.log(e) + (n - k) * math.log1p(-e)
    tail = np.logaddexp.accumulate(logs[::-1])[::-1]
    out = np.full(n + 1, np.inf)
    out[:-1] = -10 / math.log(10) * (tail[1:] - tail[:-1])
    return out


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return DEPENDENCY ** np.arange(MOST + 1) * (1 - FLOOR) + FLOOR


def _before(x: np.ndarray) -> np.ndarray:
    """How often each value stands before its place."""
    order = np.argsort(x, kind="stable")
    start = np.r_[True, x[order][1:] != x[order][:-1]]
    at = np.arange(len(x))
    out = np.empty(len(x), int)
    out[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    return out


def likelihoods(base: np.ndarray, quality: np.ndarray, reverse: np.ndarray, alleles: int = 5) -> np.ndarray:
    """(alleles, alleles) Phred-scaled -log P(bases | genotype).

    The model is defined for at most 255 bases: of more, the 255 of highest quality count (ties: forward
    strand, then earlier base). Bases of one kind and strand depend on each other, so the weight of
    the k-th falls with k; its cost is that of the k-th error of its kind among all.
    """
    out = np.zeros((alleles, alleles))
    if not len(base):
        return out
    order = np.lexsort((base, reverse, -np.asarray(quality)))[:MOST]
    n = len(order)
    b, r, q = np.asarray(base)[order].astype(int), np.asarray(reverse)[order].astype(int), np.clip(np.asarray(quality)[order].astype(int), 4, 63)
    f = _weights()[_before(2 * b + r)]
    rank, cost = _before(b), np.empty(n)
    for v in np.unique(q):
        cost[q == v] = _beta(int(v), n)[rank[q == v]]
    count, errors = np.bincount(b, minlength=alleles)[:alleles], np.bincount(b, f * cost, alleles)[:alleles]
    lc = _log_choose()
    for j in range(alleles):
        rest = [k for k in range(alleles) if k != j and count[k]]
        out[j, j] = errors[rest].sum() if rest else 0.0
        for k in range(j + 1, alleles):
            m = count[j] + count[k]
            other = [i for i in rest if i != k]
            het = -4.343 * (lc[m, count[k]] - math.log(2) * m)
            out[j, k] = out[k, j] = max(0.0, het + (errors[other].sum() if other else 0.0))
    return np.maximum(out, 0.0)
