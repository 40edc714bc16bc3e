"""Insertions and deletions: candidate types, realignment of reads to each, and genotypes through the germline caller.

A site is the base before an indel. Its reads come by a range join; what a site needs is bounded by
the depth it is admitted with. Each read is scored against a haplotype of each type, and the types then
stand in the germline caller's pile like bases.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GermlineConfig
from ..functions import reads as R
from ..operators import indel as K
from ..operators import intervals as I
from ..sources.regions import fetch
from . import germline

LETTERS = "ACGT"  # types of a site in the caller's pile: the reference, then the others by score


def events(elements: Column, seq: Column) -> Column:
    """array<struct<ref0, length, bases>>: indels that follow an aligned block; ref0 is the base before them, deletions are negative."""
    b = R.blocks(elements)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(b) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(b, i).alias("x"), F.try_element_at(b, i + 1).alias("y")))
    hits = F.filter(pairs, lambda v: F.coalesce(v["x"]["op"].isin("M", "=", "X") & v["y"]["op"].isin("I", "D"), F.lit(False)))
    inserted = lambda y: F.when(y["op"] == "I", F.upper(F.substring(seq, y["read0"] + 1, y["len"]))).otherwise("")
    return F.transform(hits, lambda v: F.struct((v["y"]["ref0"] - 1).alias("ref0"), F.when(v["y"]["op"] == "I", v["y"]["len"]).otherwise(-v["y"]["len"]).alias("length"), inserted(v["y"]).alias("bases")))


def site_reads(reads: DataFrame, min_support: int = 1, min_fraction: float = 0.002, most_types: int = 64, max_depth: int = 250, reach: int = 60) -> DataFrame:
    """A row for each read of each candidate site: (tid, contig, p, sample, rev, mapq, length, bases, part, qual, lo, hi).

    length is the read's indel behind p, 0 without one; part its bases from lo to hi. Sites need
    ``min_support`` reads with indels and their fraction, fewer than ``most_types`` lengths, and at most
    ``max_depth`` reads a sample: deeper ones are left out, as the caller's own limit.
    """
    r = reads.filter(R.placed_read(F.col("flag"), F.col("pos")) & F.col("contig").isNotNull())
    e = R.cigar_elements(F.col("cigar"))
    r = r.select("tid", "contig", "pos", "stop", "mapq", "seq", "qual", "sample", R.has(F.col("flag"), R.REVERSE).alias("rev"), e.alias("e"), events(e, F.col("seq")).alias("events"), F.monotonically_increasing_id().alias("read"))
    sites = r.select("tid", F.explode("events").alias("v"), "pos").select("tid", (F.col("pos") + F.col("v.ref0")).alias("p")).distinct().withColumn("q", F.col("p") + 1)
    own = I.range_join(r, sites.withColumnRenamed("tid", "s_tid").withColumn("tid", F.col("s_tid")).select("tid", "p", "q"), ["tid"], "pos", "stop", "p", "p").filter(F.col("stop") > F.col("p"))
    here = F.try_element_at(F.filter("events", lambda v: F.col("pos") + v["ref0"] == F.col("p")), F.lit(1))
    own = own.withColumns({"length": F.coalesce(here["length"], F.lit(0)), "bases": F.coalesce(here["bases"], F.lit("")), "lo": F.greatest(F.col("p") - reach, F.col("pos")), "hi": F.least(F.col("p") + reach, F.col("stop"))})
    good = K.candidate_types(own.select("tid", "p", "length"), min_support, min_fraction, most_types).select("tid", "p", "depth", "support", "types")
    deep = own.groupBy("tid", "p", "sample").agg(F.count(F.lit(1)).alias("n")).groupBy("tid", "p").agg(F.max("n").alias("n")).filter(F.col("n") <= max_depth).select("tid", "p")
    own = own.join(good, ["tid", "p"]).join(deep, ["tid", "p"], "left_semi")
    at = lambda x: K.query_position(F.col("e"), F.col("pos"), F.col(x))
    own = own.withColumn("from", at("lo")).withColumn("size", at("hi") - F.col("from") + 1)
    return own.select("tid", "contig", "p", "sample", "rev", "mapq", "length", "bases", F.upper(F.substring("seq", F.col("from") + 1, F.col("size"))).alias("part"), F.slice("qual", F.col("from") + 1, F.greatest(F.col("size"), F.lit(0))).alias("qual"))


def _realigned(cfg: GermlineConfig):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The reads of one site against its types: each read's type and quality, and the site's alleles."""
        ref, left = pdf["ref"].iloc[0].upper(), int(pdf["left"].iloc[0])
        at = int(pdf["p"].iloc[0]) - left
        lengths = sorted(set(pdf["length"]) | {0})
        inserted = {}
        for n in (x for x in lengths if x > 0):  # of each place the commonest base among the reads that insert so many
            own = [b for b, k in zip(pdf["bases"], pdf["length"], strict=True) if k == n and len(b) == n]
            inserted[n] = "".join(Counter(b[i] for b in own).most_common(1)[0][0] for i in range(n))
        haplotype = {n: ref[: at + 1] + inserted.get(n, "") + ref[at + 1 + max(0, -n) :] for n in lengths}
        run_ = 1
        while at + 1 + run_ < len(ref) and ref[at + 1 + run_] == ref[at + 1]:
            run_ += 1
        score = np.array([[K.glocal_score(haplotype[n], s, np.maximum(np.asarray(q, float), 1)) if len(s) else 255 for n in lengths] for s, q in zip(pdf["part"], pdf["qual"], strict=True)])
        order = np.argsort(score, axis=1, kind="stable")
        best = order[:, 0]
        first = score[np.arange(len(pdf)), best]
        second = score[np.arange(len(pdf)), order[:, 1]] if len(lengths) > 1 else first
        zero = lengths.index(0)
        # a read is no more certain than the gap to its next type, nor than such an indel is by sequencing
        size = np.array([abs(lengths[b] or (lengths[o] if len(lengths) > 1 else 1)) for b, o in zip(best, order[:, 1] if len(lengths) > 1 else best, strict=True)])
        by_run = np.where(run_ >= 3, np.floor(cfg_tandem * size / run_ + 0.499), 1000)
        quality = np.minimum(np.minimum(second - first, np.minimum(cfg_open + cfg_extend * (size - 1), by_run)), 255).astype(int)
        sums = {lengths[i]: int(quality[best == i].sum()) for i in range(len(lengths)) if (best == i).any() or i == zero}
        top = K.top_types(sums)
        most = max([0, *(-n for n in top)])
        tail = ref[at + 1 : at + 1 + most]
        allele = {n: ref[at] + inserted.get(n, "") + tail[max(0, -n) :] for n in top}
        keep = [i for i, b in enumerate(best) if lengths[b] in top]
        support = max(int((pdf["length"] == n).sum()) for n in lengths if n)
        out = pdf.iloc[keep][["tid", "p", "sample", "rev", "mapq"]]
        return out.assign(base=[LETTERS[top.index(lengths[best[i]])] for i in keep], quality=quality[keep], alleles=[[allele[n] for n in top]] * len(keep), idv=support, imf=support / len(pdf))

    cfg_open, cfg_extend, cfg_tandem = 40, 20, 100  # fixed values: gap open, gap extension and tandem costs
    return run


def pile(reads: DataFrame, reference: DataFrame, cfg: GermlineConfig | None = None, chunk: int = 4096, reach: int = 60, **limits) -> DataFrame:
    """The germline caller's pile over indel types, with the site's alleles, its support (idv) and fraction (imf)."""
    cfg = cfg or GermlineConfig()
    rows = site_reads(reads, reach=reach, **limits)
    lengths = reference.groupBy("contig").agg(F.max(F.col("chunk") * chunk + F.length("bases")).alias("end"))
    spans = rows.select("tid", "contig", "p").distinct().join(lengths, "contig")
    spans = spans.select("tid", "contig", "p", F.greatest(F.col("p") - reach, F.lit(0)).alias("start"), F.least(F.col("p") + 2 * reach, F.col("end") - 1).alias("stop"))
    windows = fetch(reference, spans, chunk).select("tid", "p", F.col("start").alias("left"), F.col("bases").alias("ref"))
    schema = "tid int, p int, sample string, rev boolean, mapq int, base string, quality int, alleles array<string>, idv int, imf double"
    return rows.drop("contig").join(windows, ["tid", "p"]).groupBy("tid", "p").applyInPandas(_realigned(cfg), schema)


def call(reads: DataFrame, reference: DataFrame, cfg: GermlineConfig | None = None, chunk: int = 4096, **options) -> DataFrame:
    """Called indel sites: ref and alt as strings, genotypes, idv and imf."""
    cfg = cfg or GermlineConfig()
    rows = pile(reads, reference, cfg, chunk, **options)
    site = rows.groupBy("tid", "p").agg(F.first("alleles").alias("alleles"), F.first("idv").alias("idv"), F.first("imf").alias("imf"))
    found = germline.call(rows.withColumns({"ref": F.lit("A"), "is_del": F.lit(False)}), cfg)
    named = found.join(site, ["tid", "p"])
    text = lambda x: F.get("alleles", F.instr(F.lit(LETTERS), x) - 1)
    return named.withColumns({"ref": text(F.col("ref")), "alt": F.transform("alt", text)}).drop("alleles")
