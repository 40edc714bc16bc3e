"""Multi-sample calling: per-sample sums -> site -> allele subset -> genotypes, as grouped DataFrames.

A pile row carries tid, p, ref, base, quality, mapq, rev, sample and optionally qpos / qlen. Samples
are aggregated first (a partial aggregate), sites after that; the caller's small numeric kernel runs
in Arrow batches over site rows, never per read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GermlineConfig
from ..operators.errmodel import likelihoods

BASES = "ACGT"


def effective_quality(base_q: Column, mapq: Column, cfg: GermlineConfig = GermlineConfig()) -> Column:
    """min(base, mapping (255 counts as 20, capped)), between 4 and 63."""
    m = F.least(F.when(mapq == 255, 20).otherwise(mapq), F.lit(cfg.cap_mapq))
    return F.greatest(F.lit(4), F.least(base_q, m, F.lit(63)))


def samples(pile: DataFrame, cfg: GermlineConfig | None = None) -> DataFrame:
    """One row a (tid, p, sample): quality sums, allele depths by strand, moments and the bases for the error model."""
    cfg = cfg or GermlineConfig()
    rows = pile.filter(~F.col("is_del")).withColumn("eq", effective_quality(F.col("quality"), F.col("mapq"), cfg))
    used = F.col("quality") >= cfg.min_baseq
    mq = F.least(F.when(F.col("mapq") == 255, 20).otherwise(F.col("mapq")), F.lit(cfg.cap_mapq))
    diff = F.col("base") != F.col("ref")
    per = rows.groupBy("tid", "p", "ref", "sample", "base", "eq", "rev", used.alias("used")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapq") == 0).alias("mq0"), F.sum("quality").alias("bq"), F.sum(F.col("quality") * F.col("quality")).alias("bq2"), F.sum(mq).alias("mq"), F.sum(mq * mq).alias("mq2"))
    total = lambda value, cond: F.coalesce(F.sum(F.when(cond & F.col("used"), value)), F.lit(0)).cast("long")
    n, base, rev = F.col("n"), F.col("base"), F.col("rev")
    cols = [F.sum("n").alias("depth"), F.sum("mq0").alias("mq0"), F.array(*[total(n * F.col("eq"), base == b) for b in BASES]).alias("qsum"), F.array(*[total(n, (base == b) & ~rev) for b in BASES]).alias("adf"), F.array(*[total(n, (base == b) & rev) for b in BASES]).alias("adr")]
    moments = [total(n, d & r) for d in (~diff, diff) for r in (~rev, rev)] + [total(F.col(v), d) for pair in (("bq", "bq2"), ("mq", "mq2")) for d in (~diff, diff) for v in pair]
    cols += [F.array(*moments).alias("anno"), F.collect_list(F.when(F.col("used"), F.struct("base", F.col("eq").alias("q"), "rev", "n"))).alias("bases")]
    return per.groupBy("tid", "p", "ref", "sample").agg(*cols)


def combine(per_sample: DataFrame) -> DataFrame:
    """One row a site: quality shares summed over samples, alleles (reference first, then by share), summed counts."""
    sums = per_sample.withColumn("total", F.aggregate("qsum", F.lit(0).cast("long"), lambda a, x: a + x))
    share = lambda i: F.sum(F.when(F.col("total") > 0, F.col("qsum")[i] / F.col("total")).otherwise(0.0))
    site = sums.groupBy("tid", "p", "ref").agg(F.array(*[share(i) for i in range(4)]).alias("qs"), F.sum("depth").alias("depth"), F.sum("mq0").alias("mq0"), F.array(*[F.sum(F.col("anno")[i]) for i in range(12)]).alias("anno"), F.array_sort(F.collect_list(F.struct("sample", "qsum", "adf", "adr", "anno", "bases"))).alias("samples"))
    others = F.filter(F.transform("qs", lambda q, i: F.struct((-q).alias("k"), (-i).alias("i"), F.substring(F.lit(BASES), i + 1, F.lit(1)).alias("b"))), lambda x: (x["k"] < 0) & (x["b"] != F.col("ref")))
    alts = F.transform(F.array_sort(others), lambda x: x["b"])
    site = site.withColumn("alleles", F.concat(F.array("ref"), alts))
    return site.withColumn("allele_qs", F.transform("alleles", lambda b: F.col("qs")[F.instr(F.lit(BASES), b) - 1]))


def phred_likelihoods(bases: list, alleles: list[str]) -> np.ndarray:
    """PL of one sample in the order (0/0, 0/1, 1/1, 0/2, ...); <*> stands for a base nobody shows."""
    code = {b: i for i, b in enumerate(BASES)}
    b = np.repeat([code.get(x["base"], 4) for x in bases], [x["n"] for x in bases]) if bases else np.zeros(0, int)
    q = np.repeat([x["q"] for x in bases], [x["n"] for x in bases]) if bases else np.zeros(0, int)
    r = np.repeat([x["rev"] for x in bases], [x["n"] for x in bases]) if bases else np.zeros(0, int)
    lk = likelihoods(b.astype(int), q.astype(int), r.astype(int))
    unseen = next((i for i in range(4) if BASES[i] not in alleles), 4)
    at = [code.get(a, unseen) for a in alleles]
    p = np.array([lk[at[j], at[i]] for i in range(len(at)) for j in range(i + 1)])
    return np.minimum(255, (p - p.min() + 0.499).astype(int))


def probabilities(pl: np.ndarray) -> np.ndarray:
    """Normalised P(data | genotype) from PLs, rows of samples; a flat row is missing data and all 0."""
    p = 10.0 ** (-np.minimum(pl, 255) / 10.0)
    flat = np.isclose(p.sum(1), p.shape[1])
    return np.where(flat[:, None], 0.0, p / p.sum(1, keepdims=True))


def prior(samples_: int, theta: float = 1.1e-3) -> float:
    n = 2 * samples_
    return math.log(min(0.99, theta * (1 + sum(1 / i for i in range(2, n)))))


def gt_index(a: int, b: int) -> int:
    a, b = min(a, b), max(a, b)
    return b * (b + 1) // 2 + a


def best_alleles(pdg: np.ndarray, qs: np.ndarray, theta: float) -> tuple[tuple[int, ...], float, float]:
    """(alleles, reference log likelihood, log sum of all others): subsets of one to three alleles under Hardy-Weinberg shares.

    An earlier subset wins a tie. ``theta`` is the log prior of each allele that isn't the reference.
    """
    n = len(qs)
    best, best_lk, ref_lk, others = (0,), -math.inf, 0.0, -math.inf
    sizes = [itertools.combinations(range(n), 1)] + [((b, a) for a in range(n) for b in range(a))] * (n > 1) + [((c, b, a) for a in range(n) for b in range(a) for c in range(b))] * (n > 2)
    for subset in itertools.chain(*sizes):
        if len(subset) > 1 and any(qs[i] == 0 for i in subset):
            continue
        f = {i: (qs[i] / sum(qs[j] for j in subset) if len(subset) > 1 else 1.0) for i in subset}
        value = sum((1 if a == b else 2) * f[a] * f[b] * pdg[:, gt_index(a, b)] for a, b in itertools.combinations_with_replacement(subset, 2))
        seen = value > 0
        lk = float(np.log(value[seen]).sum())
        if subset == (0,):
            ref_lk = lk
        lk += theta * sum(i > 0 for i in subset)
        if lk > best_lk:
            best, best_lk = subset, lk
        if subset != (0,) and (seen.any() or len(subset) == 3):
            others = np.logaddexp(lk, others)
    return best, ref_lk, float(others)


def genotypes(pdg: np.ndarray, qs: np.ndarray, kept: tuple[int, ...], ploidy: np.ndarray | None = None) -> list[tuple[int, ...] | None]:
    """The most likely genotype of each sample among the kept alleles; null without data or chromosomes."""
    out: list[tuple[int, ...] | None] = []
    for s, p in enumerate(pdg):
        sets = 2 if ploidy is None else int(ploidy[s])
        if not sets or not (p != 0).any():
            out.append(None)
            continue
        one = [((a, a), p[gt_index(a, a)] * qs[a] ** 2) for a in kept]
        two = [((b, a), 2 * p[gt_index(a, b)] * qs[a] * qs[b]) for a in kept for b in kept if b < a] if sets == 2 else []
        top = max([v for _, v in one + two], default=0)
        pair = next((g for g, v in one + two if v == top and v > 0), (0, 0))
        out.append(pair if sets == 2 else pair[:1])
    return out


def genotype_quality(scores: list[float]) -> int:
    total, top = sum(scores), max(scores, default=0.0)
    if total <= 0:
        return 0
    left = 1 - top / total
    return 127 if left <= 0 else min(127, int(-4.34294 * math.log(left)))


def site_quality(ref_lk: float, others: float, variant: bool) -> float:
    both = np.logaddexp(others, ref_lk)
    q = min(999.0, -4.343 * ((ref_lk if variant else others) - both))
    return float(np.rint(q)) if q > 50 else float(abs(q))


SITE = "tid int, p int, ref string, alt array<string>, qual double, depth bigint, an int, ac array<int>, dp4 array<bigint>, mq int, nref int, nalt int, nhets int, ndiploid int, samples array<struct<sample:string,gt:string,gq:int,pl:array<int>>>"


def _call(cfg: GermlineConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for r in (call_site(x, cfg) for x in b.to_dict("records")) if r is not None]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SITE.split(", ")])

    return run


def call_site(x: dict, cfg: GermlineConfig) -> dict | None:
    alleles = [*list(x["alleles"])[:4]]
    if len(alleles) < 4:
        alleles.append("<*>")
    qs = np.array([*list(x["allele_qs"])[:4], 0.0][: len(alleles)], float)
    people = list(x["samples"])
    pl = np.stack([phred_likelihoods([b for b in s["bases"] if b is not None], alleles) for s in people])
    pdg = probabilities(pl)
    if qs.sum() and not qs[0] and x["depth"]:
        qs[0] = 1.0 / x["depth"] / len(people)
    if qs.sum():
        qs = qs / qs.sum()
    kept, ref_lk, others = best_alleles(pdg, qs, prior(len(people), cfg.theta))
    kept = tuple(sorted({0, *kept}))
    if cfg.variants_only and kept == (0,):
        return None
    gts = genotypes(pdg, qs, kept)
    flat = [a for g in gts if g for a in g]
    ac = [flat.count(a) for a in kept[1:]]
    if cfg.variants_only and not sum(ac):
        return None
    place = {a: i for i, a in enumerate(kept)}
    text = lambda g: "./." if g is None else "/".join(str(place[a]) for a in g)
    trim = [gt_index(a, b) for i, b in enumerate(kept) for a in kept[: i + 1]]
    scores = lambda p: [(1 if a == b else 2) * p[gt_index(a, b)] * qs[a] * qs[b] for a, b in itertools.combinations_with_replacement(kept, 2)]
    anno = list(x["anno"])
    total = sum(anno[:4])
    return {
        "tid": x["tid"], "p": x["p"], "ref": x["ref"], "alt": [alleles[a] for a in kept[1:]], "qual": site_quality(ref_lk, others, bool(sum(ac))), "depth": x["depth"], "an": len(flat), "ac": ac, "dp4": anno[:4],
        "mq": int((anno[8] + anno[10]) / total) if total else 0, "nref": flat.count(0), "nalt": sum(ac), "nhets": sum(1 for g in gts if g and len(set(g)) > 1), "ndiploid": sum(1 for g in gts if g and len(g) == 2),
        "samples": [{"sample": s["sample"], "gt": text(g), "gq": genotype_quality(scores(p)) if g else 0, "pl": [int(v) for v in r[trim]]} for s, g, p, r in zip(people, gts, pdg, pl, strict=True)],
    }


def constrained(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sites of ``wanted`` (tid, p, alts) with the reference and those alleles alone, in their order; of repeated sites the first by alts counts."""
    one = wanted.groupBy("tid", "p").agg(F.min("alts").alias("alts"))
    others = F.filter(F.array_distinct("alts"), lambda b: (b != F.col("ref")) & b.isin(*BASES))
    s = sites.join(one, ["tid", "p"]).withColumn("alleles", F.slice(F.concat(F.array("ref"), others), 1, 4)).drop("alts")
    return s.withColumn("allele_qs", F.transform("alleles", lambda b: F.col("qs")[F.instr(F.lit(BASES), b) - 1]))


def call(pile: DataFrame, cfg: GermlineConfig | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Called sites with genotypes; without ``cfg.call`` every covered site keeps its likelihoods only (see combine).

    With ``wanted`` sites, these are called with their alleles alone, variant or not.
    """
    cfg = cfg or GermlineConfig()
    sites = combine(samples(pile, cfg))
    if wanted is not None:
        sites, cfg = constrained(sites, wanted), replace(cfg, variants_only=False)
    if not cfg.call:
        return sites
    if cfg.variants_only:
        sites = sites.filter(F.size("alleles") > 1)
    return sites.select("tid", "p", "ref", "alleles", "allele_qs", "depth", "anno", "samples").mapInPandas(_call(cfg), SITE)


def histograms(pile: DataFrame, cfg: GermlineConfig | None = None) -> DataFrame:
    """(tid, p, sample, kind, side, bin, n): what the bias tests compare, counted; at most a few hundred rows a site and sample.

    pos: place in the aligned read in 100 bins, bq and mq: base and mapping quality up to 59, each of
    reference (side 0) and other bases (1); mqs: mapping quality of forward and reverse reads. Needs
    read_pos (1-based place without clips) and read_len (without clips).
    """
    cfg = cfg or GermlineConfig()
    rows = pile.filter(~F.col("is_del") & (F.col("quality") >= cfg.min_baseq))
    diff, rev = (F.col("base") != F.col("ref")).cast("int"), F.col("rev").cast("int")
    mq = F.least(F.when(F.col("mapq") == 255, 20).otherwise(F.col("mapq")), F.lit(cfg.cap_mapq), F.lit(59))
    kinds = {"pos": (diff, F.floor(F.col("read_pos") / (F.col("read_len") + 1) * 100)), "bq": (diff, F.least(F.col("quality"), F.lit(59))), "mq": (diff, mq), "mqs": (rev, mq)}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), side.alias("side"), b.cast("int").alias("bin")) for k, (side, b) in kinds.items()])
    return rows.select("tid", "p", "sample", F.explode(each).alias("h")).groupBy("tid", "p", "sample", "h.kind", "h.side", "h.bin").agg(F.count(F.lit(1)).alias("n"))


def _tests() -> str:
    return "tid int, p int, vdb double, rpb double, mqb double, mqsb double, bqb double"


def _bias(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..operators import bias

    for b in batches:
        out = []
        for tid, p, counts in zip(b["tid"], b["p"], b["h"], strict=True):
            h = {(k, s): np.zeros(100) for k in ("pos", "bq", "mq", "mqs") for s in (0, 1)}
            for x in counts:
                h[x["kind"], x["side"]][x["bin"]] += x["n"]
            two = lambda k: bias.mann_whitney(h[k, 0], h[k, 1])  # noqa: E731, B023
            out.append((tid, p, bias.variant_distance_bias(h["pos", 1]), two("pos"), two("mq"), two("mqs"), two("bq")))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _tests().split(", ")])
        yield frame.astype({c: "float64" for c in frame.columns[2:]})


def with_tags(calls: DataFrame, pile: DataFrame, cfg: GermlineConfig | None = None) -> DataFrame:
    """Called sites with their bias tests, the share of mapping quality 0, segregation, inbreeding and heterozygote bias.

    Only the pile of called sites is counted. Its rows meet up to 100,000 sites by broadcast, more by a
    broadcast bit filter that lets a few others pass; the pile is never shuffled, its counts are.
    Calls are written to the shared folder first.
    """
    from ..llm.common import bit_filter, filter_bits, materialize, may_be_in
    from ..operators import bias

    cfg = cfg or GermlineConfig()
    calls = materialize(calls, "calls")
    site, n = F.struct(F.col("tid"), F.col("p")), calls.count()
    if n <= 100_000:
        own = pile.join(F.broadcast(calls.select("tid", "p")), ["tid", "p"], "left_semi")
    else:
        own = may_be_in(pile, site, bit_filter(calls, site, filter_bits(n)), filter_bits(n))
    h = histograms(own.withColumn("sample", F.lit("")), cfg).groupBy("tid", "p", "kind", "side", "bin").agg(F.sum("n").alias("n"))
    tests = h.groupBy("tid", "p").agg(F.collect_list(F.struct("kind", "side", "bin", "n")).alias("h")).mapInPandas(_bias, _tests())
    bases = own.filter(~F.col("is_del"))
    used = F.col("quality") >= cfg.min_baseq
    per = bases.groupBy("tid", "p", "sample").agg(F.count_if(used & (F.col("base") != F.col("ref"))).alias("o"), F.count_if(used).alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapq") == 0).alias("z"))
    site = per.groupBy("tid", "p").agg(F.collect_list("o").alias("o"), F.collect_list("d").alias("d"), (F.sum("z") / F.sum("n")).alias("mq0f"))
    site = site.select("tid", "p", "mq0f", bias.segregation_bias(F.col("o"), F.col("d")).alias("sgb"))
    n = (F.col("nref"), F.col("nalt"), F.col("nhets"), F.col("ndiploid"))
    out = calls.join(site, ["tid", "p"], "left").join(tests, ["tid", "p"], "left")
    return out.withColumns({"icb": bias.inbreeding_column(*n), "hob": bias.heterozygote_bias(*n)})
