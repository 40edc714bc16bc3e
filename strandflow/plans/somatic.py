"""Somatic calling as one plan: pile -> per-locus histograms -> three alternatives -> rules -> best candidate.

Input: a pile of reads of both samples with mates folded (see operators.pileup). A locus is
aggregated once; what the rules need of single reads (offsets, mapping qualities, strands) is kept
per base. Power comes from dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SomaticConfig
from ..functions import text as X
from ..operators import likelihood as L
from ..operators.intervals import first_match
from ..operators.power import with_power

#: rejection reasons in the order they are tested (fixed values)
REASONS = ("fstar_tumor_lod", "nearby_gap_events", "possible_contamination", "germline_risk", "normal_lod", "alt_allele_in_normal", "clustered_read_position", "strand_artifact", "poor_mapping_region_mapq0", "poor_mapping_region_alternate_allele_mapq", "seen_in_panel_of_normals", "triallelic_site")


def weighted_median(h: Column) -> Column:
    """Median of a sorted histogram array<struct<v, n>>; the mean of the middle two of an even number; null of none."""
    total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        """Adds x once for each of the two middle ranks that it holds."""
        holds = lambda rank: ((a["seen"] <= rank) & (rank < a["seen"] + x["n"])).cast("int")
        both = holds(F.floor((total - 1) / 2)) + holds(F.floor(total / 2))
        return F.struct((a["seen"] + x["n"]).alias("seen"), (a["sum"] + both * x["v"]).alias("sum"))

    return F.when(total > 0, F.aggregate(h, start, step, lambda a: a["sum"] / 2))


def deviations(h: Column, middle: Column) -> Column:
    """The histogram of distances from ``middle``, sorted."""
    return F.sort_array(F.transform(h, lambda x: F.struct(F.abs(x["v"] - middle).alias("v"), x["n"].alias("n"))))


def loci(pile: DataFrame, cfg: SomaticConfig) -> DataFrame:
    """One row a locus: histograms and counters of both samples.

    Pile columns: tid, p, ref, base, quality, mapq, rev, sample (TUMOR / NORMAL), fwd_offset,
    rev_offset, gap (I / D / null), clean (passes the read filter). Rows are counted by
    (base, quality, strand, ...) first, a partial aggregate, and gathered per locus after that;
    offsets are counted per base, so no state grows with depth beyond the length of a read.
    """
    tumor = F.col("sample") == "TUMOR"

    per = pile.groupBy("tid", "p", "ref", "sample", "base", "quality", "rev", (F.col("mapq") > 0).alias("placed"), "clean", "is_del").agg(
        F.count(F.lit(1)).alias("n"), F.max("mapq").alias("mapq"), F.count_if(F.col("gap") == "I").alias("ins"), F.count_if((F.col("gap") == "D") | F.col("is_del")).alias("dels"),
    )
    hist = lambda cond: F.collect_list(F.when(cond, F.struct("base", F.col("quality").alias("q"), "n")))
    use = (~F.col("is_del")) & (F.col("quality") >= cfg.min_qscore)
    top = use & F.col("placed")
    pick = tumor & top & F.col("clean")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    site = per.groupBy("tid", "p", "ref").agg(
        hist(tumor & top).alias("t_final"), hist(pick).alias("t_clean"), hist(pick & ~F.col("rev")).alias("t_fwd"), hist(pick & F.col("rev")).alias("t_rev"),
        hist(tumor & top & (F.col("quality") > cfg.min_qsum_qscore)).alias("t_sums"), hist(~tumor & use).alias("n_used"), hist(~tumor & top).alias("n_final"),
        total(tumor & top).alias("t_depth"), total(~tumor & top).alias("n_depth"), total(tumor & top & (F.col("quality") >= 20)).alias("t_q20"), total(~tumor & top & (F.col("quality") >= 20)).alias("n_q20"),
        total(use & ~F.col("placed")).alias("mq0"), total(use).alias("reads"), F.coalesce(F.sum(F.when(tumor, F.col("ins"))), F.lit(0)).alias("t_ins"), F.coalesce(F.sum(F.when(tumor, F.col("dels"))), F.lit(0)).alias("t_del"),
        F.collect_list(F.when(pick, F.struct("base", "mapq"))).alias("t_reads"),
    )
    picked = pile.withColumn("placed", F.col("mapq") > 0).filter(pick)
    ends = F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"{k}_offset").cast("double").alias("v")) for k in ("fwd", "rev")])
    places = picked.select("tid", "p", "ref", "base", F.explode(ends).alias("e")).groupBy("tid", "p", "ref", "base", "e.end", "e.v").agg(F.count(F.lit(1)).alias("n"))
    places = places.groupBy("tid", "p", "ref").agg(F.collect_list(F.struct("base", "end", "v", "n")).alias("t_places"))
    return site.join(places, ["tid", "p", "ref"], "left")


def _quality_sum(hist: Column, base: Column) -> Column:
    return F.aggregate(F.filter(hist, lambda h: h["base"] == base), F.lit(0).cast("long"), lambda a, h: a + h["n"] * h["q"])


def candidates(sites: DataFrame, cfg: SomaticConfig, dbsnp: DataFrame | None = None, cosmic: DataFrame | None = None) -> DataFrame:
    """Up to three rows a locus, all measures and the array of reasons that reject the candidate."""
    cfg = cfg.effective()
    mark = lambda df, side, name: df.withColumn(name, F.lit(False)) if side is None else first_match(df, side.withColumn(name, F.lit(True)).withColumn("m_one", F.lit(1)), ["tid", "p"], ["m_one"], [name]).withColumn(name, F.coalesce(name, F.lit(False)))
    s = mark(mark(sites.filter(F.col("ref").isin("A", "C", "G", "T")), dbsnp, "dbsnp"), cosmic, "cosmic")
    s = s.withColumn("at_risk", F.col("dbsnp") & ~F.col("cosmic"))
    c = L.alternatives(s)
    h, ref, alt = F.col("t_final"), F.col("ref"), F.col("alt")
    if not cfg.force_output:
        c = c.filter(L.count_of(F.col("t_sums"), alt) > 0)
    c = c.withColumn("f0", L.allele_fraction(h, ref, alt))
    c = c.withColumn("lod0", L.lod(h, ref, alt, F.col("f0")))
    if not cfg.force_output:
        c = c.filter((F.col("f0") >= cfg.tumor_f_pretest) & (F.col("lod0") >= cfg.initial_tumor_lod) & (F.size("t_clean") > 0))
    fraction = max(cfg.minimum_mutation_cell_fraction, cfg.fraction_contamination)
    t = F.col("t_clean")
    c = c.withColumns({"contaminant_lod": L.contaminant_lod(h, ref, alt, fraction, F.col("f0")), "tumor_f": L.allele_fraction(t, ref, alt), "f_fwd": L.allele_fraction(F.col("t_fwd"), ref, alt), "f_rev": L.allele_fraction(F.col("t_rev"), ref, alt)})
    gl = lambda hist: L.genotype_likelihoods(hist, ref, F.lit(0.5))
    c = c.withColumns({"n_gl": gl(F.col("n_used")), "t_gl": gl(t), "t_lod": L.lod(t, ref, alt, F.col("tumor_f")), "t_lod_fwd": L.lod(F.col("t_fwd"), ref, alt, F.col("f_fwd")), "t_lod_rev": L.lod(F.col("t_rev"), ref, alt, F.col("f_rev"))})
    mine = F.filter("t_reads", lambda r: r["base"] == F.col("alt"))
    own = lambda end: F.filter("t_places", lambda x: (x["base"] == F.col("alt")) & (x["end"] == end))
    offsets = lambda end: F.sort_array(F.transform(F.coalesce(own(end), F.array().cast("array<struct<base:string,end:string,v:double,n:bigint>>")), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"))))
    count = lambda col, b: L.count_of(F.col(col), b)
    c = c.withColumns({
        "init_t_lod": L.alt_versus_ref(F.col("t_gl"), ref, alt), "init_n_lod": L.ref_versus_alt(F.col("n_gl"), ref, alt), "normal_gt": L.best_genotype(F.col("n_gl")),
        "normal_f": F.greatest(L.allele_fraction(F.col("n_used"), ref, alt), F.lit(cfg.minimum_normal_allele_fraction)), "n_alt": count("n_used", alt), "n_ref": count("n_used", ref), "n_alt_sum": _quality_sum(F.col("n_used"), alt), "n_ref_sum": _quality_sum(F.col("n_used"), ref),
        "t_alt": count("t_clean", alt), "t_ref": count("t_clean", ref), "t_alt_sum": _quality_sum(t, alt), "t_ref_sum": _quality_sum(t, ref), "ref_fwd": count("t_fwd", ref), "ref_rev": count("t_rev", ref), "alt_fwd": count("t_fwd", alt), "alt_rev": count("t_rev", alt),
        "alt_mapq": F.coalesce(F.array_max(F.transform(mine, lambda r: r["mapq"])), F.lit(0)), "ref_mapq": F.coalesce(F.array_max(F.transform(F.filter("t_reads", lambda r: r["base"] == F.col("ref")), lambda r: r["mapq"])), F.lit(0)),
        "fwd_sorted": offsets("fwd"), "rvs_sorted": offsets("rev"),
        "fwd_depth": F.aggregate("t_fwd", F.lit(0).cast("long"), lambda a, x: a + x["n"]), "rev_depth": F.aggregate("t_rev", F.lit(0).cast("long"), lambda a, x: a + x["n"]),
    })
    c = c.withColumns({"fwd_median": weighted_median(F.col("fwd_sorted")), "rev_median": weighted_median(F.col("rvs_sorted"))})
    c = c.withColumns({"fwd_mad": weighted_median(deviations(F.col("fwd_sorted"), F.col("fwd_median"))), "rev_mad": weighted_median(deviations(F.col("rvs_sorted"), F.col("rev_median")))})
    c = with_power(c, "tumor", "rev_depth", "power_pos", cfg.eps, cfg.strand_artifact_lod, "tumor_f")
    c = with_power(c, "tumor", "fwd_depth", "power_neg", cfg.eps, cfg.strand_artifact_lod, "tumor_f")
    return c.withColumn("reasons", reasons(cfg))


def reasons(cfg: SomaticConfig) -> Column:
    c = F.col
    tests = [("fstar_tumor_lod", c("t_lod") < cfg.tumor_lod)]
    if not cfg.artifact_detection_mode:
        near = lambda m, d: F.coalesce((c(m) <= cfg.pir_median_threshold) & (c(d) <= cfg.pir_mad_threshold), F.lit(False))
        tests += [
            ("nearby_gap_events", (c("t_ins") >= cfg.gap_events_threshold) | (c("t_del") >= cfg.gap_events_threshold)),
            ("possible_contamination", F.lit(cfg.fraction_contamination + cfg.minimum_mutation_cell_fraction > 0) & (c("t_lod") <= F.lit(cfg.tumor_lod) + F.greatest(F.lit(0.0), c("contaminant_lod")))),
            ("germline_risk", c("at_risk") & (c("init_n_lod") < cfg.normal_dbsnp_lod)),
            ("normal_lod", c("init_n_lod") < cfg.normal_lod),
            ("alt_allele_in_normal", ((c("n_alt") >= cfg.max_alt_in_normal_count) | (c("normal_f") >= cfg.max_alt_in_normal_fraction)) & (c("n_alt_sum") > cfg.max_alt_in_normal_qsum)),
            ("clustered_read_position", near("fwd_median", "fwd_mad") | near("rev_median", "rev_mad")),
            ("strand_artifact", ((c("power_neg") >= cfg.strand_artifact_power) & (c("t_lod_fwd") < cfg.strand_artifact_lod)) | ((c("power_pos") >= cfg.strand_artifact_power) & (c("t_lod_rev") < cfg.strand_artifact_lod))),
            ("poor_mapping_region_mapq0", (c("reads") > 0) & (F.try_divide(c("mq0").cast("float"), c("reads").cast("float")).cast("float").cast("double") >= cfg.fraction_mapq0_threshold)),
            ("poor_mapping_region_alternate_allele_mapq", c("alt_mapq") < cfg.required_max_alt_mapq),
        ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def best(found: DataFrame, cfg: SomaticConfig) -> DataFrame:
    """One candidate a locus: the highest first score, the later alternative on a tie; several good ones are all tri-allelic."""
    if cfg.force_alleles:
        return found
    cols = found.columns
    one = found.groupBy("tid", "p").agg(F.count_if(F.col("t_lod") >= cfg.tumor_lod).alias("good"), F.max_by(F.struct(*cols), F.struct("init_t_lod", "alt")).alias("top"))
    out = one.select("good", "top.*").withColumn("reasons", F.when(F.col("good") > 1, F.array_append("reasons", F.lit("triallelic_site"))).otherwise(F.col("reasons"))).drop("good")
    return out.filter(F.size("reasons") == 0) if cfg.only_passing_calls else out


def covered(cfg: SomaticConfig) -> Column:
    cfg = cfg.effective()
    normal = F.when(F.col("at_risk"), cfg.normal_covered_depth_dbsnp).otherwise(cfg.normal_covered_depth)
    out = F.col("t_depth") >= cfg.tumor_covered_depth
    return out & (F.col("n_depth") >= normal) if cfg.has_normal else out


def with_site_power(found: DataFrame, cfg: SomaticConfig) -> DataFrame:
    """tumor_power, normal_power (by the prior that holds) and their product."""
    c = with_power(found, "tumor", "t_depth", "tumor_power", cfg.eps, cfg.tumor_lod, cfg.power_af)
    c = with_power(c, "normal", "n_depth", "normal_power_nsp", cfg.eps, cfg.normal_lod)
    c = with_power(c, "normal", "n_depth", "normal_power_wsp", cfg.eps, cfg.normal_dbsnp_lod)
    c = c.withColumn("normal_power", F.when(F.col("at_risk"), F.col("normal_power_wsp")).otherwise(F.col("normal_power_nsp")))
    return c.withColumn("power", F.col("tumor_power") * F.col("normal_power") if cfg.has_normal else F.col("tumor_power"))


def call(pile: DataFrame, cfg: SomaticConfig | None = None, dbsnp: DataFrame | None = None, cosmic: DataFrame | None = None) -> DataFrame:
    """The whole caller over a pile with mates folded: one row a called locus."""
    cfg = cfg or SomaticConfig()
    out = best(candidates(loci(pile, cfg), cfg, dbsnp, cosmic), cfg)
    return with_site_power(out, cfg).withColumn("covered", covered(cfg)).withColumn("judgement", X.judgement(F.col("reasons")))
