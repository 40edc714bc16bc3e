"""Column functions over one alignment record: flags, CIGAR, fragment geometry, read filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits (fixed values)
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800


def has(flag: Column, bits: int) -> Column:
    """Any of the bits is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def cigar_elements(cigar: Column) -> Column:
    """CIGAR text to array<struct<op, len>>; '*' and null give an empty array."""
    ops = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    lens = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def cigar_text(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")


def _length(elements: Column, ops: str) -> Column:
    return F.aggregate(elements, F.lit(0), lambda a, e: a + F.when(F.instr(F.lit(ops), e["op"]) > 0, e["len"]).otherwise(0))


def reference_length(elements: Column) -> Column:
    return _length(elements, "MDN=X")


def read_length(elements: Column) -> Column:
    return _length(elements, "MIS=X")


def alignment_end(pos: Column, elements: Column) -> Column:
    """Last covered position, 0-based; a CIGAR without reference bases ends before it starts."""
    return pos - 1 + reference_length(elements)


def soft_clip_fraction(elements: Column) -> Column:
    """Soft-clipped share of all operations, in single precision; null without operations."""
    total = F.aggregate(elements, F.lit(0), lambda a, e: a + e["len"])
    return F.when(total > 0, (_length(elements, "S").cast("float") / total.cast("float")).cast("float"))


def heavily_clipped(elements: Column, threshold: float) -> Column:
    return F.coalesce(soft_clip_fraction(elements).cast("double") >= F.lit(threshold), F.lit(False))


def well_defined_fragment(flag: Column, pos: Column, end: Column, mate_pos: Column, isize: Column) -> Column:
    """Paired, both ends placed on opposite strands, and lying inside one another's insert."""
    both = (isize != 0) & has(flag, PAIRED) & ~has(flag, UNMAPPED) & ~has(flag, MATE_UNMAPPED) & (has(flag, REVERSE) != has(flag, MATE_REVERSE))
    return both & F.when(has(flag, REVERSE), end > mate_pos).otherwise(pos <= mate_pos + isize)


def adaptor_boundary(flag: Column, pos: Column, end: Column, mate_pos: Column, isize: Column) -> Column:
    """First adaptor position beside the fragment; null where the fragment isn't well defined."""
    beside = F.when(has(flag, REVERSE), mate_pos - 1).otherwise(pos + F.abs(isize) + 1)
    return F.when(well_defined_fragment(flag, pos, end, mate_pos, isize), beside)


def inside_adaptor(at: Column, boundary: Column, flag: Column, isize: Column) -> Column:
    """The position is read through into the adaptor; long inserts (signed size over 100) never are."""
    beyond = F.when(has(flag, REVERSE), at <= boundary).otherwise(at >= boundary)
    return F.coalesce((isize <= 100) & beyond, F.lit(False))


def placed_read(flag: Column, pos: Column) -> Column:
    """Reads a locus walk admits: mapped, primary (supplementary ones stay), no duplicate, no failed check."""
    return ~has(flag, UNMAPPED | SECONDARY | DUPLICATE | QC_FAIL) & (pos >= 0)


def germline_read(flag: Column, mapq: Column, exclude: int, require: int = 0, min_mapq: int = 0, keep_orphans: bool = False) -> Column:
    out = ~has(flag, UNMAPPED) & ~has(flag, exclude) & (mapq >= min_mapq)
    if require:
        out = out & has(flag, require)
    return out if keep_orphans else out & ~(has(flag, PAIRED) & ~has(flag, PROPER))


def blocks(elements: Column) -> Column:
    """array<struct<op, len, ref0, read0>>: each operation with its offsets in reference and read."""
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,len:int,ref0:int,read0:int>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        ref = F.when(F.instr(F.lit("MDN=X"), e["op"]) > 0, e["len"]).otherwise(0)
        read = F.when(F.instr(F.lit("MIS=X"), e["op"]) > 0, e["len"]).otherwise(0)
        one = F.struct(e["op"].alias("op"), e["len"].alias("len"), a["ref"].alias("ref0"), a["read"].alias("read0"))
        return F.struct((a["ref"] + ref).alias("ref"), (a["read"] + read).alias("read"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(elements, start, step, lambda a: a["out"])


def read_position(offset: Column, elements: Column) -> Column:
    """1-based place of a base in its read without the leading soft clip."""
    lead = F.when(F.element_at(elements, 1)["op"] == "S", F.element_at(elements, 1)["len"]).otherwise(0)
    return offset + 1 - lead


def aligned_read_length(elements: Column) -> Column:
    return _length(elements, "MI=X")


def indel_quality(open_q: int, ext_q: int, tandem_q: int, length: Column, run: Column) -> Column:
    """Phred score that an indel of this length is no sequencing error, given the homopolymer run."""
    size = F.abs(length)
    tandem = F.when(run >= 3, (F.lit(float(tandem_q)) * size / run + 0.499).cast("int")).otherwise(F.lit(1000))
    return F.least(F.lit(open_q) + F.lit(ext_q) * (size - 1), tandem)
