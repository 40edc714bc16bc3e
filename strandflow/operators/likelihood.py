"""Allele and genotype likelihoods over per-locus (base, quality) histograms, in log10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import GENOTYPES


def _log10(x: Column) -> Column:
    """IEEE: log10 of 0 is -inf."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(float("-inf")))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside lambdas a plain expression would be repeated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_log_likelihood(base: Column, q: Column, ref: Column, alt: Column, f: Column) -> Column:
    """Of one read for alt fraction f; bases that are neither add nothing."""
    e = F.pow(F.lit(10.0), -q / 10.0)
    return F.when(base == ref, _log10(f * e / 3 + (1 - f) * (1 - e))).when(base == alt, _log10(f * (1 - e) + (1 - f) * e / 3)).otherwise(F.lit(0.0))


def log_likelihood(hist: Column, ref: Column, alt: Column, f: Column) -> Column:
    return let(f, lambda v: F.aggregate(hist, F.lit(0.0), lambda a, h: a + h["n"] * read_log_likelihood(h["base"], h["q"], ref, alt, v)))


def lod(hist: Column, ref: Column, alt: Column, f: Column, f0: Column | None = None) -> Column:
    return log_likelihood(hist, ref, alt, f) - log_likelihood(hist, ref, alt, F.lit(0.0) if f0 is None else f0)


def lods(loci: DataFrame, keys: list[str], fractions: dict[str, Column], hist: str = "hist", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """(keys, name...): log-likelihood of each fraction over that of 0, for every row of ``loci``.

    The histogram is unnested and summed again, which compiled code does; ``keys`` hold what the
    histogram is grouped by, so no row changes its partition.
    """
    rows = loci.select(*keys, ref, alt, *[f.alias(f"f_{k}") for k, f in fractions.items()], F.explode(hist).alias("h"))
    h, n = F.col("h"), F.col("h.n")
    at = lambda f: read_log_likelihood(h["base"], h["q"], F.col(ref), F.col(alt), f)
    none = F.sum(n * at(F.lit(0.0)))
    return rows.groupBy(*keys, ref, alt).agg(*[(F.sum(n * at(F.col(f"f_{k}"))) - none).alias(k) for k in fractions])


def count_of(hist: Column, base: Column) -> Column:
    return F.aggregate(F.filter(hist, lambda h: h["base"] == base), F.lit(0).cast("long"), lambda a, h: a + h["n"])


def allele_fraction(hist: Column, ref: Column, alt: Column) -> Column:
    n, m = count_of(hist, alt), count_of(hist, ref)
    return F.coalesce(F.try_divide(n, n + m), F.lit(0.0))


def base_probability(read_base: Column, q: Column, true_base: Column) -> Column:
    """log10 P(read base | true base): right with 1 - e, each wrong base with e / 3."""
    return F.when(read_base == true_base, _log10(1 - F.pow(F.lit(10.0), -q / 10.0))).otherwise(-q / 10.0 - F.log10(F.lit(3.0)))


def genotype_likelihood(hist: Column, ref: Column, a: Column, b: Column, f: Column) -> Column:
    """A heterozygote with the reference reads its other base at rate f; other genotypes half and half."""
    share = F.when((a == b) | ((ref != a) & (ref != b)), 0.5).when(ref == a, 1 - f).otherwise(f)

    def one(h: Column, wa: Column) -> Column:
        e = F.pow(F.lit(10.0), -h["q"] / 10.0)
        read = lambda x: F.when(h["base"] == x, 1 - e).otherwise(e / 3)
        # both alleles wrong or both right: no weight matters; never 0 as qualities are over 0
        return F.when((h["q"] > 0) & (F.instr(F.lit("ACGT"), h["base"]) > 0), h["n"] * F.log10(wa * read(a) + (1 - wa) * read(b))).otherwise(0.0)

    return let(share, lambda wa: F.aggregate(hist, F.lit(0.0), lambda s, h: s + one(h, wa)))


def genotype_likelihoods(hist: Column, ref: Column, f: Column) -> Column:
    """array<double> in the fixed order of the ten genotypes."""
    names = F.array(*[F.lit(g) for g in GENOTYPES])
    return F.transform(names, lambda g: genotype_likelihood(hist, ref, F.substring(g, 1, 1), F.substring(g, 2, 1), f))


def best_genotype(likelihoods: Column) -> Column:
    """The last of the most likely."""
    names = F.array(*[F.lit(g) for g in GENOTYPES])
    top = F.array_max(likelihoods)
    last = F.array_max(F.transform(likelihoods, lambda x, i: F.when(x == top, i).otherwise(-1)))
    return F.element_at(names, last + 1)


def of_genotype(likelihoods: Column, a: Column, b: Column) -> Column:
    pair = F.array_join(F.array_sort(F.array(a, b)), "")
    at = F.array_position(F.array(*[F.lit(g) for g in GENOTYPES]), pair).cast("int")
    return F.element_at(likelihoods, at)


def log_add(a: Column, b: Column) -> Column:
    """max + ln(1 + 10^(min - max)): natural and decimal logarithms mixed, as published."""
    return F.greatest(a, b) + F.ln(1 + F.pow(F.lit(10.0), F.least(a, b) - F.greatest(a, b)))


def ref_versus_alt(likelihoods: Column, ref: Column, alt: Column) -> Column:
    return of_genotype(likelihoods, ref, ref) - log_add(of_genotype(likelihoods, ref, alt), of_genotype(likelihoods, alt, alt))


def alt_versus_ref(likelihoods: Column, ref: Column, alt: Column) -> Column:
    return log_add(of_genotype(likelihoods, ref, alt), of_genotype(likelihoods, alt, alt)) - of_genotype(likelihoods, ref, ref)


def het_versus_ref(likelihoods: Column, ref: Column, alt: Column) -> Column:
    return of_genotype(likelihoods, ref, alt) - of_genotype(likelihoods, ref, ref)


def contaminated(hist: Column, ref: Column, alt: Column, fraction: float) -> Column:
    """The histogram after contamination: only the int(n * fraction) best alt bases stay, the others read as reference."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, h: a + h["n"])
    room = F.floor(total * fraction).cast("long")
    alts = F.reverse(F.array_sort(F.transform(F.filter(hist, lambda h: h["base"] == alt), lambda h: F.struct(h["q"].alias("q"), h["n"].alias("n")))))
    start = F.struct(room.alias("room"), F.array().cast("array<struct<base:string,q:int,n:bigint>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        keep = F.least(a["room"], h["n"])
        one = lambda b, n: F.struct(b.alias("base"), h["q"].cast("int").alias("q"), n.cast("long").alias("n"))
        return F.struct((a["room"] - keep).alias("room"), F.concat(a["out"], F.array(one(alt, keep), one(ref, h["n"] - keep))).alias("out"))

    split = F.aggregate(alts, start, step, lambda a: a["out"])
    rest = F.transform(F.filter(hist, lambda h: h["base"] != alt), lambda h: F.struct(h["base"].alias("base"), h["q"].cast("int").alias("q"), h["n"].cast("long").alias("n")))
    return F.filter(F.concat(split, rest), lambda h: h["n"] > 0)


def contaminant_lod(hist: Column, ref: Column, alt: Column, fraction: float, tumor_f: Column) -> Column:
    """Heterozygote against reference once the pile is contaminated."""
    diff = lambda c, f: genotype_likelihood(c, ref, ref, alt, f) - genotype_likelihood(c, ref, ref, ref, f)
    return let(contaminated(hist, ref, alt, fraction), lambda c: let(F.least(F.lit(fraction), tumor_f), lambda f: diff(c, f)))


def contaminant_lods(loci: DataFrame, keys: list[str], fraction: float, tumor_f: Column, name: str = "contaminant_lod", hist: str = "hist", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """(keys, ref, alt, name): :func:`contaminant_lod` of every row, summed over the unnested histogram."""
    mixed = contaminated(F.col(hist), F.col(ref), F.col(alt), fraction)
    rows = loci.select(*keys, ref, alt, F.least(F.lit(fraction), tumor_f).alias("c_f"), F.explode(mixed).alias("h"))
    h = F.col("h")
    e = F.pow(F.lit(10.0), -h["q"] / 10.0)
    read = lambda b: F.when(h["base"] == F.col(b), 1 - e).otherwise(e / 3)
    gain = F.log10((1 - F.col("c_f")) * read(ref) + F.col("c_f") * read(alt)) - F.log10(read(ref))
    return rows.groupBy(*keys, ref, alt).agg(F.sum(F.when((h["q"] > 0) & h["base"].isin("A", "C", "G", "T"), h["n"] * gain).otherwise(0.0)).alias(name))


def alternatives(loci: DataFrame, ref: str = "ref") -> DataFrame:
    """A row for each of the three other bases of a locus."""
    return loci.withColumn("alt", F.explode(F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.col(ref))))
