"""Depth limits: levelling down-sampling of groups of reads that start together, and a plain cap."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lcg import JavaRandom


def level(sizes: Sequence[int], target: int, least: int = 1) -> list[int]:
    """Sizes after taking one item at a time, round robin, from groups over ``least`` until ``target`` is met.

    Closed form of the rounds: all groups sink to a common level; the leftover of the last round is
    taken from the first groups that still stand over it.
    """
    out = list(sizes)
    excess = sum(out) - target
    if excess <= 0:
        return out
    lo, hi = least, max(out, default=least)
    while lo < hi:  # the smallest level that doesn't take too much
        mid = (lo + hi) // 2
        if sum(max(0, s - max(mid, least)) for s in out) <= excess:
            hi = mid
        else:
            lo = mid + 1
    rest = excess - sum(max(0, s - lo) for s in out)
    out = [min(s, max(lo, least)) if s > least else s for s in out]
    for i, s in enumerate(out):
        if rest > 0 and s > least and s == lo:
            out[i] -= 1
            rest -= 1
    return out


def levelled(reads: DataFrame, keys: Sequence[str], start: str, order: Sequence[str], target: int, seed: int = 47382911) -> DataFrame:
    """Reads of each key thinned to ``target`` live reads by levelling groups with one start.

    The live set is walked in position order: reads that end before the current start leave; when
    more than ``target`` are live, groups are levelled and survivors drawn by a seeded shuffle; a
    discarded read never returns. Needs (start, stop). Keys should be intervals or chunks of a
    contig, as a key is walked by one task.
    """
    schema = reads.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, *order], ignore_index=True)
        rng, live, gone = JavaRandom(seed), [], set()
        for at, rows in pdf.groupby(start, sort=True).groups.items():
            live = [(s, [i for i in idx if pdf["stop"].iat[i] >= at]) for s, idx in live]
            live = [(s, idx) for s, idx in live if idx] + [(at, list(rows))]
            sizes = [len(idx) for _, idx in live]
            if sum(sizes) > target:
                for g, keep in enumerate(level(sizes, target)):
                    s, idx = live[g]
                    if keep < len(idx):
                        chosen = sorted(rng.sample_indices(len(idx), keep))
                        kept = [idx[c] for c in chosen]
                        gone.update(set(idx) - set(kept))
                        live[g] = (s, kept)
        return pdf.drop(index=sorted(gone))

    return reads.groupBy(*keys).applyInPandas(run, schema)


def capped(pile: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows of a locus and file, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pile.withColumn("c_no", F.row_number().over(w)).filter(F.col("c_no") <= most).drop("c_no")


def file_depth(most: int, total: int, files: int) -> int:
    """The cap of one file: raised where all files together stay under the total."""
    return max(most, total // files) if most * files < total else most
