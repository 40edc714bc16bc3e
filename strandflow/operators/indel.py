"""Indel candidates and per-read realignment scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R


def candidate_types(marks: DataFrame, min_support: int = 1, min_fraction: float = 0.002, most_types: int = 64) -> DataFrame:
    """(tid, p, types): array<struct<length, n>> of indel lengths (0: none) at positions with enough indel reads.

    ``marks``: (tid, p, length), a row for each read at p, length 0 without an indel behind it.
    Positions with ``most_types`` lengths or more are left out.
    """
    per = marks.groupBy("tid", "p", "length").agg(F.count(F.lit(1)).alias("n"))
    site = per.groupBy("tid", "p").agg(F.sum("n").alias("depth"), F.sum(F.when(F.col("length") != 0, F.col("n")).otherwise(0)).alias("support"), F.array_sort(F.collect_list(F.struct("length", "n"))).alias("types"))
    enough = (F.col("support") >= min_support) & (F.col("support") / F.col("depth") >= min_fraction)
    return site.filter(enough & (F.size("types") < most_types) & (F.col("support") > 0))


def top_types(scores: dict[int, int], reference: int = 0, most: int = 4) -> list[int]:
    """The reference type first, then others by score; at most ``most``."""
    rest = sorted((t for t in scores if t != reference), key=lambda t: (-scores[t], t))
    return [reference, *rest][:most]


def repeat_extent(ref: Column, pos: Column, length: Column, inserted: Column | None = None) -> Column:
    """How many positions behind ``pos`` (0-based) go on repeating an indel's bases.

    The bases are those inserted, or the ``length`` deleted ones behind pos. With m mismatches among
    the first i positions the stretch is worth i - 11 m; it is followed while that is not negative
    and ends where it is worth most.
    """
    size = F.abs(length)
    unit = F.upper(F.coalesce(inserted, F.substring(ref, pos + 2, size)) if inserted is not None else F.substring(ref, pos + 2, size))
    behind = F.upper(F.substring(ref, pos + 2, F.greatest(F.length(ref) - pos - 1, F.lit(0))))
    odd = F.transform(F.filter(F.split(behind, ""), lambda x: x != ""), lambda x, i: x != F.substring(unit, i % F.length(unit) + 1, F.lit(1)))
    zero = F.struct(*[F.lit(0).alias(k) for k in ("i", "m", "worth", "end")], F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        i, m = a["i"] + 1, a["m"] + x.cast("int")
        on = a["on"] & (i >= 11 * m)
        more = on & (i - 11 * m > a["worth"])
        return F.struct(i.alias("i"), m.alias("m"), F.when(more, i - 11 * m).otherwise(a["worth"]).alias("worth"), F.when(more, i).otherwise(a["end"]).alias("end"), on.alias("on"))

    return F.when(F.length(unit) > 0, F.aggregate(odd, zero, step, lambda a: a["end"])).otherwise(0)


def query_position(elements: Column, pos: Column, target: Column) -> Column:
    """Read offset of a reference position, from the blocks of a CIGAR.

    Inside a deletion or skip it is the read offset where that begins; before the alignment the first
    aligned base, behind it the base after the last aligned one (clips and insertions there don't count).
    """
    b = R.blocks(elements)
    rel = target - pos
    aligned = F.filter(b, lambda x: x["op"].isin("M", "=", "X"))
    holds = F.filter(b, lambda x: x["op"].isin("M", "=", "X", "D", "N") & (x["ref0"] <= rel) & (rel < x["ref0"] + x["len"]))
    at = F.try_element_at(holds, F.lit(1))
    last = F.try_element_at(aligned, F.lit(-1))
    inside = at["read0"] + F.when(at["op"].isin("M", "=", "X"), rel - at["ref0"]).otherwise(0)
    return F.coalesce(F.when(rel < 0, F.try_element_at(aligned, F.lit(1))["read0"]).when(F.size(holds) > 0, inside).otherwise(last["read0"] + last["len"]), F.lit(0))


def homopolymer_run(ref: Column, pos: Column) -> Column:
    """Length of the run of one base that holds the position right of ``pos`` (0-based); 0 behind the end."""
    bases = F.upper(ref)
    base = F.substring(bases, pos + 2, F.lit(1))
    upto, behind = F.substring(bases, F.lit(1), pos + 2), F.substring(bases, pos + 3, F.length(ref))
    run = F.length(upto) - F.length(F.rtrim(upto, base)) + F.length(behind) - F.length(F.ltrim(behind, base))
    return F.when(pos + 1 < F.length(ref), run).otherwise(0)


def glocal_score(ref: str, query: str, quality: np.ndarray, gap_open: float = 1e-4, gap_extend: float = 1e-2, band: int = 10) -> int:
    """Phred-scaled -log likelihood that ``query`` comes from ``ref``: a pair HMM, global in the read, local in the reference.

    Read base i is aligned within ``band`` reference bases of the diagonals that both ends allow, so
    the work is the read's length times the band and the difference of the lengths.
    """
    if not query or not ref:
        return 255
    m, n = len(query), len(ref)
    r = np.frombuffer(ref.upper().encode(), np.uint8)
    q = np.frombuffer(query.upper().encode(), np.uint8)
    e = 10.0 ** (-np.asarray(quality, float) / 10)
    d, x = gap_open, gap_extend
    spread = max(n - m, 0)
    match, ins, dele = np.full(n + 1, 1.0 / n), np.zeros(n + 1), np.zeros(n + 1)
    total = 0.0
    for i in range(m):
        lo, hi = max(1, i + 1 - band), min(n, i + 1 + spread + band)
        if lo > hi:
            return 255
        here = r[lo - 1 : hi]
        hit = np.where((here == ord("N")) | (q[i] == ord("N")), 1.0, np.where(here == q[i], 1 - e[i], e[i] / 3))
        new, new_ins, new_del = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        new[lo : hi + 1] = hit * ((1 - 2 * d) * match[lo - 1 : hi] + (1 - x) * (ins[lo - 1 : hi] + dele[lo - 1 : hi]))
        new_ins[lo : hi + 1] = 0.25 * (d * match[lo : hi + 1] + x * ins[lo : hi + 1])
        for k in range(lo + 1, hi + 1):
            new_del[k] = d * new[k - 1] + x * new_del[k - 1]
        scale = new.sum() + new_ins.sum()
        if scale <= 0:
            return 255
        match, ins, dele = new / scale, new_ins / scale, new_del / scale
        total += np.log10(scale)
    return int(min(255, -10 * total + 0.499))


def realign(rows: pd.DataFrame) -> pd.DataFrame:
    """Scores of each read of one site against each type's consensus; columns: seq, qual, haplotypes (array of strings)."""
    out = [[glocal_score(h, s, np.asarray(q)) for h in hs] for s, q, hs in zip(rows["seq"], rows["qual"], rows["haplotypes"], strict=True)]
    return rows.assign(scores=out)
