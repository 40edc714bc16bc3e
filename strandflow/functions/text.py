"""Column functions over text: tokens, numbers as text, header tags, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, separator: str) -> Column:
    """Split at a one-character separator; empty tokens go."""
    return F.filter(F.split(text, f"\\Q{separator}\\E"), lambda t: t != "")


def round_nearest(value: Column, digits: int) -> Column:
    """Half away from zero."""
    return F.round(value, digits)


def _product(a: Column, b: float) -> tuple[Column, Column]:
    """a * b as the nearest double and the exact rest (both factors split in halves of 26 bits)."""
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    b_hi = b * 134217729.0 - (b * 134217729.0 - b)
    b_lo = b - b_hi
    a_hi = half(a)
    a_lo = a - a_hi
    p = a * b
    return p, ((a_hi * b_hi - p) + a_hi * b_lo + a_lo * b_hi) + a_lo * b_lo


def fixed(value: Column, digits: int = 6) -> Column:
    """The value at ``digits`` decimals as printf's %f: what the double holds is rounded, half to even.

    0.0375 lies below the tie and gives 0.037. A place that looks like a tie is decided by the rest of
    an exact product.
    """
    size = F.abs(value)
    p, rest = _product(size, 10.0**digits)
    low = F.floor(p)
    part = p - low
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
    units = low.cast("bigint") + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    ten = F.lit(10**digits).cast("bigint")
    whole = F.floor((units - units % ten) / ten).cast("bigint")
    own = [sign, whole.cast("string")] + ([F.lit("."), F.lpad((units % ten).cast("string"), digits, "0")] if digits else [])
    return F.when(p < 2.0**52, F.concat(*own)).otherwise(F.format_string(f"%.{digits}f", value))


def round_nearest_text(value: Column, digits: int = 6) -> Column:
    """The shortest decimal that rounds like the value at ``digits`` decimals (see :func:`fixed`); 0 if that small."""
    cut = F.regexp_replace(fixed(value, digits), r"\.?0+$", "") if digits else fixed(value, 0)
    return F.when(F.abs(value) < 5.0 * 10.0 ** -(digits + 1), F.lit("0")).otherwise(cut)


def significant(value: Column, digits: int = 6) -> Column:
    """The value at so many significant digits, trailing zeros cut, with an exponent under -4 or from ``digits`` on, as printf's %g."""
    parts = F.split(F.format_string(f"%.{digits - 1}e", value), "e")
    mantissa, power = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")
    cut = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    plain = cut(F.concat(mantissa, F.lit("E"), power.cast("string")).try_cast(f"decimal(38,{digits + 4})").cast("string"))
    far = F.concat(cut(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(value == 0, "0").when(power.between(-4, digits - 1), plain).otherwise(far)


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def header_tags(line: Column) -> Column:
    """TAG -> value of a SAM header line; fields without a colon are skipped, values end at a second colon."""
    fields = F.filter(F.slice(F.split(line, "\t"), F.lit(2), F.size(F.split(line, "\t"))), lambda t: F.instr(t, ":") > 0)
    pairs = F.transform(fields, lambda t: F.struct(F.substring_index(t, ":", 1).alias("key"), F.element_at(F.split(t, ":"), 2).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))


def site_label(dbsnp: Column, cosmic: Column) -> Column:
    return F.when(dbsnp & cosmic, "DBSNP+COSMIC").when(dbsnp, "DBSNP").when(cosmic, "COSMIC").otherwise("NOVEL")


def covered_label(covered: Column) -> Column:
    return F.when(covered, "COVERED").otherwise("UNCOVERED")


def judgement(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "KEEP").otherwise("REJECT")


def strand_text(ref_fwd: Column, ref_rev: Column, alt_fwd: Column, alt_rev: Column) -> Column:
    return F.format_string("(%d,%d,%d,%d)", ref_fwd, ref_rev, alt_fwd, alt_rev)


def locus_text(contig: Column, start: Column, stop: Column) -> Column:
    """contig, contig:start or contig:start-stop; unmapped where there is none."""
    return F.when(contig.isNull(), "unmapped").when(start.isNull(), contig).when(start == stop, F.concat(contig, F.lit(":"), start.cast("string"))).otherwise(F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string")))


def vcf_info(info: Column) -> Column:
    """INFO text to map<string,string>; flags map to an empty string, '.' to an empty map."""
    parts = F.filter(F.split(F.coalesce(info, F.lit(".")), ";"), lambda t: (t != "") & (t != "."))
    return F.map_from_entries(F.transform(parts, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.when(F.instr(t, "=") > 0, F.regexp_extract(t, "=(.*)$", 1)).otherwise("").alias("value"))))


def no_call(allele: Column) -> Column:
    return allele == "."


def null_allele(allele: Column) -> Column:
    return (allele == "-") | (allele == "")


def symbolic_allele(allele: Column) -> Column:
    bracketed = (F.startswith(allele, F.lit("<")) & F.endswith(allele, F.lit(">"))) | F.contains(allele, F.lit("[")) | F.contains(allele, F.lit("]"))
    return (F.length(allele) > 2) & bracketed
