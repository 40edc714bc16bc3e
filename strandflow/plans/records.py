"""From alignment records, a reference and target intervals to the pile both callers read.

Aligned blocks are cut at the reference's chunks and joined to them before any position is unnested,
so the shuffle carries a row a block; bases, qualities and reference letters are taken from strings
inside a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GermlineConfig, SomaticConfig
from ..functions import reads as R
from ..operators import intervals as I
from ..operators import pileup as P
from ..sources.regions import fetch
from . import germline, somatic

ORDER = ("pos", "name", "flag", "cigar", "seq")


def in_targets(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """Reads that overlap any (contig, start, stop) interval, 0-based closed."""
    merged = I.merge(targets, ["contig"]).select("contig", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    return I.range_join(reads, merged, ["contig"], "pos", "stop", "t_start", "t_stop", "left_semi")


def aligned(reads: DataFrame, reference: DataFrame, chunk: int = 4096, cigar: str = "cigar") -> DataFrame:
    """Reads unnested over the positions of their aligned and deleted blocks: p, ref, base, quality, offset, is_del beside the reads' columns.

    Blocks are cut at the reference's chunks and joined to them first. Deleted positions have base D and
    the offset and quality of the base before them; positions outside the reference give no row.
    """
    b = F.col("b")
    rows = reads.withColumn("b", F.explode(F.filter(R.blocks(R.cigar_elements(F.col(cigar))), lambda x: x["op"].isin("M", "=", "X", "D") & (x["len"] > 0))))
    rows = rows.select(*reads.columns, (b["op"] == "D").alias("is_del"), b["read0"].alias("read0"), (F.col("pos") + b["ref0"]).alias("first"), (F.col("pos") + b["ref0"] + b["len"] - 1).alias("last"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / chunk).cast("int"), F.floor(F.col("last") / chunk).cast("int"))))
    lo, hi = F.greatest(F.col("first"), F.col("chunk") * chunk), F.least(F.col("last"), (F.col("chunk") + 1) * chunk - 1)
    rows = rows.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")}).join(reference.select("contig", "chunk", "bases"), ["contig", "chunk"])
    rows = rows.withColumn("letters", F.upper(F.substring("bases", F.col("lo") - F.col("chunk") * chunk + 1, F.col("hi") - F.col("lo") + 1))).drop("bases")
    rows = rows.withColumn("p", F.explode(F.sequence("lo", "hi")))
    offset = F.when(F.col("is_del"), F.col("read0") - 1).otherwise(F.col("read0") + F.col("p") - F.col("first"))
    rows = rows.withColumns({"offset": offset.cast("int"), "ref": F.substring("letters", F.col("p") - F.col("lo") + 1, F.lit(1))})
    rows = rows.withColumns({"base": F.when(F.col("is_del"), P.DELETION).otherwise(F.upper(F.substring("seq", F.col("offset") + 1, F.lit(1)))), "quality": F.coalesce(F.get("qual", "offset"), F.lit(0))})
    return rows.filter(F.col("ref") != "").drop("read0", "first", "last", "lo", "hi", "letters", "chunk")


def capped_quality(reads: DataFrame, reference: DataFrame, threshold: int = 50, chunk: int = 4096) -> DataFrame:
    """(qname, flag, pos, cap): the mapping quality that a read's mismatches allow; -1 where there are too many.

    Bases of quality 13 or more count; a mismatch costs its quality, at most 33, less what so many
    mismatches among so many bases are worth by chance; clipped bases cost a fifth of their quality, hard clips
    13 each. Reads without such a base keep the threshold.
    """
    keys = ["qname", "flag", "contig", "pos", "cigar", "read"]
    r = reads.filter(F.col("contig").isNotNull()).withColumn("read", F.monotonically_increasing_id())
    good = ~F.col("is_del") & (F.col("quality") >= 13)
    odd = good & F.col("base").isin("A", "C", "G", "T") & F.col("ref").isin("A", "C", "G", "T") & (F.col("base") != F.col("ref"))
    rows = aligned(r.select(*keys, "seq", "qual"), reference, chunk)
    sums = rows.groupBy("read").agg(F.count_if(good).alias("n"), F.count_if(odd).alias("m"), F.coalesce(F.sum(F.when(odd, F.least("quality", F.lit(33)))), F.lit(0)).alias("cost"))
    soft = F.filter(R.blocks(R.cigar_elements(F.col("cigar"))), lambda x: x["op"] == "S")
    hard = F.aggregate(F.filter(R.cigar_elements(F.col("cigar")), lambda x: x["op"] == "H"), F.lit(0), lambda a, x: a + x["len"])
    clip = F.aggregate(F.flatten(F.transform(soft, lambda x: F.slice(F.col("qual"), x["read0"] + 1, x["len"]))), F.lit(0), lambda a, q: a + q) + hard * 13
    out = r.select(*keys, clip.alias("clip")).join(sums, "read", "left").na.fill(0, ["n", "m", "cost"])
    chance = F.when(F.col("m") > 0, F.col("m") * F.ln(F.greatest(F.col("n"), F.lit(1))) - F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("m"), F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + F.ln(i))).otherwise(0.0)
    t = F.col("cost") - 4.343 * chance + F.col("clip") / 5.0
    cap = F.when(t > threshold, -1).otherwise((F.sqrt((threshold - F.greatest(t, F.lit(0.0))) / threshold) * threshold + 0.499).cast("int"))
    return out.select("qname", "flag", "pos", cap.alias("cap"))


def pile(reads: DataFrame, reference: DataFrame, targets: DataFrame | None = None, cfg: SomaticConfig | None = None, chunk: int = 4096, fold: bool = True, retain=None) -> DataFrame:
    """A row for each base or deleted position of each admitted read, with its reference letter.

    ``reads``: alignment records with tid and sample. ``reference``: (contig, chunk, bases). Reads
    that are unmapped, secondary, duplicate or failed are left out; so are positions read through
    into the adaptor, N bases and positions outside the reference and the targets. ``clean`` says
    that a read is not heavily clipped and its mismatches within the half window sum up to no more
    than the limit; gap names an insertion or deletion near the base. Of mates that cover one
    position at most one stays (``fold``; ``retain`` as in the operator, reads of the NORMAL sample
    as a rule).
    """
    cfg = cfg or SomaticConfig()
    r = reads.filter(R.placed_read(F.col("flag"), F.col("pos")) & F.col("contig").isNotNull())
    if targets is not None:
        r = in_targets(r, targets)
    e = R.cigar_elements(F.col("cigar"))
    beside = R.adaptor_boundary(F.col("flag"), F.col("pos"), F.col("stop"), F.col("mate_pos"), F.col("isize"))
    r = r.select("tid", "contig", F.col("qname").alias("name"), "flag", "pos", "stop", "mapq", "cigar", "isize", "seq", "qual", "sample", R.has(F.col("flag"), R.REVERSE).alias("rev"), e.alias("e"), beside.alias("beside"), F.monotonically_increasing_id().alias("read"))
    r = P.mate_counts(r, name="name", keys=("tid", "sample"))
    rows = aligned(r.withColumn("heavy", R.heavily_clipped(F.col("e"), cfg.heavily_clipped_read_fraction)), reference, chunk)
    rows = rows.filter((F.col("base") != "N") & ~R.inside_adaptor(F.col("p"), F.col("beside"), F.col("flag"), F.col("isize")))
    near = Window.partitionBy("read").orderBy("p").rangeBetween(-cfg.reference_half_window, cfg.reference_half_window)
    odd = F.when(~F.col("is_del") & (F.col("base") != F.col("ref")), F.col("quality")).otherwise(0)
    rows = rows.withColumn("clean", ~F.col("heavy") & (F.sum(odd).over(near) <= cfg.max_read_mismatch_quality_sum))
    size = R.read_length(F.col("e"))
    rows = rows.select("tid", "contig", "p", "ref", "base", "quality", "mapq", "rev", "sample", "is_del", "clean", "offset", F.col("offset").alias("fwd_offset"), (size - F.col("offset") - 1).alias("rev_offset"), P.gap_event(F.col("e"), F.col("offset"), cfg.gap_event_proximity).alias("gap"), R.read_position(F.col("offset"), F.col("e")).alias("read_pos"), R.aligned_read_length(F.col("e")).alias("read_len"), "mates", *ORDER)
    if targets is not None:
        rows = in_targets(rows.withColumns({"read_pos": F.col("pos"), "pos": F.col("p"), "stop": F.col("p")}), targets).withColumn("pos", F.col("read_pos")).drop("read_pos", "stop")
    if not fold:
        return rows
    keep = (F.col("sample") == "NORMAL") if retain is None else retain
    return P.overlap_filter(rows, ORDER, name="name", retain=keep, keys=("tid", "p", "sample"))


def somatic_calls(reads: DataFrame, reference: DataFrame, targets: DataFrame | None = None, cfg: SomaticConfig | None = None, dbsnp: DataFrame | None = None, cosmic: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Called loci of records whose sample is TUMOR or NORMAL, with their contig and the context of seven reference letters."""
    out = somatic.call(pile(reads, reference, targets, cfg, chunk), cfg, dbsnp, cosmic)
    names = reads.select("tid", "contig").distinct()
    named = out.join(names, "tid")
    spans = named.select("tid", "p", "contig", F.greatest(F.col("p") - 3, F.lit(0)).alias("start"), (F.col("p") + 3).alias("stop"))
    from ..functions.bases import sequence_context

    near = fetch(reference, spans, chunk).select("tid", "p", sequence_context(F.col("bases"), (F.col("p") - F.col("start")).cast("int")).alias("context"))
    return named.join(near, ["tid", "p"], "left")


def germline_calls(reads: DataFrame, reference: DataFrame, targets: DataFrame | None = None, cfg: GermlineConfig | None = None, chunk: int = 4096) -> DataFrame:
    """Genotyped sites of records of any samples with their tags; every overlapping mate counts once."""
    rows = pile(reads, reference, targets, chunk=chunk, retain=F.lit(False))
    return germline.with_tags(germline.call(rows, cfg), rows, cfg)
