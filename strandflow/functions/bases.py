"""Column functions over bases, qualities and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: order of the ten diploid genotypes, IUPAC codes of base pairs
GENOTYPES = ("AA", "AC", "CC", "AG", "CG", "GG", "AT", "CT", "GT", "TT")
IUPAC = {"AA": "A", "AC": "M", "AG": "R", "AT": "W", "CA": "M", "CC": "C", "CG": "S", "CT": "Y", "GA": "R", "GC": "S", "GG": "G", "GT": "K", "TA": "W", "TC": "Y", "TG": "K", "TT": "T"}


def base_index(base: Column) -> Column:
    """A or * 0, C 1, G 2, T 3, any case; others -1."""
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when(base == "*", F.lit(0)).when(F.length(base) == 1, at).otherwise(F.lit(-1))


def iupac(a: Column, b: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.concat(F.upper(a), F.upper(b))), F.lit("N"))


def phred(p: Column) -> Column:
    """-10 log10 p, at most 99 (also for p = 0)."""
    return F.when(p <= 0, F.lit(99.0)).otherwise(F.least(F.lit(99.0), F.lit(-4.3429) * F.ln(p)))


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def shift_illumina13(q: Column) -> Column:
    return F.when(q > 31, q - 31).otherwise(F.lit(0))


def decode_quality(text: Column) -> Column:
    """Phred+33 text to array<int>; '*' is empty."""
    return F.when(F.coalesce(text, F.lit("*")) == "*", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))


def sequence_context(bases: Column, at: Column, reach: int = 3) -> Column:
    """Bases around a 0-based position, the centre replaced by x, upper case."""
    left = F.substring(bases, F.greatest(at - reach + 1, F.lit(1)), F.least(F.lit(reach), at))
    return F.concat(F.upper(left), F.lit("x"), F.upper(F.substring(bases, at + 2, F.lit(reach))))


def genotype_index(a: Column, b: Column) -> Column:
    """Index of an unordered allele pair (from 0): b(b+1)/2 + a with a <= b."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (hi * (hi + 1) / 2).cast("int") + lo


def genotype_alleles(index: Column) -> Column:
    hi = F.floor((F.sqrt(index * 8.0 + 1) - 1) / 2).cast("int")
    return F.struct((index - (hi * (hi + 1) / 2).cast("int")).alias("a"), hi.alias("b"))
