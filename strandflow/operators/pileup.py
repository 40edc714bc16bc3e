"""Pileup as relational operators: unnest reads over positions, fold overlapping mates, aggregate per locus.

A pile row is (contig keys..., p, base, qual, mapq, rev, is_del, ...). Everything here is grouped by
(tid, p), so partitions split the genome finely and no interval halo is needed. Wide per-locus state
is kept as counts per (base, quality), which is bounded by the alphabet whatever the depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R

LOCUS = ("tid", "p")
DELETION = "D"


def unnest(reads: DataFrame, keep: Sequence[str], cigar: str = "cigar", pos: str = "pos", seq: str | None = None, qual: str | None = None) -> DataFrame:
    """One row for each covered reference position of each read.

    Columns: ``keep``, p, offset (in the read), is_del and, given ``seq`` / ``qual``, base and
    quality. Skips (N) give no row; a deleted position has base D and the offset and quality of the
    read base before it. H and P use nothing.
    """
    b = F.col("b")
    rows = reads.withColumn("b", F.explode(F.filter(R.blocks(R.cigar_elements(F.col(cigar))), lambda x: F.instr(F.lit("M=XD"), x["op"]) > 0)))
    rows = rows.filter(b["len"] > 0).withColumn("k", F.explode(F.sequence(F.lit(0), b["len"] - 1)))
    gone = b["op"] == "D"
    offset = F.when(gone, b["read0"] - 1).otherwise(b["read0"] + F.col("k"))
    cols = [*keep, (F.col(pos) + b["ref0"] + F.col("k")).alias("p"), offset.alias("offset"), gone.alias("is_del")]
    if seq:
        cols.append(F.when(gone, DELETION).otherwise(F.substring(F.col(seq), offset + 1, F.lit(1))).alias("base"))
    if qual:
        cols.append(F.get(F.col(qual), offset).alias("quality"))
    return rows.select(*cols)


def depth(pile: DataFrame, keys: Sequence[str] = LOCUS) -> DataFrame:
    return pile.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"))


def depth_by_boundaries(spans: DataFrame, tid: str = "tid", start: str = "start", stop: str = "stop", segment: int = 16384, weights: dict[str, Column] | None = None) -> DataFrame:
    """Depth of covered positions from span ends alone: (tid, p, depth), and a sum for each of ``weights`` of the spans.

    Spans add 1 at their start and take it away after their stop; a running sum over fixed segments
    of the contig gives the depth, each segment opened with what spans it. Per-base rows appear only
    after aggregation, so the shuffle carries two rows a span (and one for each segment it enters).
    """
    named = {"depth": F.lit(1)} | (weights or {})
    s = spans.select(F.col(tid).alias("tid"), F.col(start).alias("a"), F.col(stop).alias("b"), *[w.cast("int").alias(k) for k, w in named.items()]).filter("a <= b")
    inside = s.withColumn("seg", F.explode(F.sequence(F.floor(F.col("a") / segment), F.floor(F.col("b") / segment))))
    lo, hi = F.greatest(F.col("a"), F.col("seg") * segment), F.least(F.col("b"), (F.col("seg") + 1) * segment - 1)
    two = F.array(F.struct(lo.alias("at"), F.lit(1).alias("sign")), F.struct((hi + 1).alias("at"), F.lit(-1).alias("sign")))
    ends = inside.select("tid", "seg", *named, F.explode(two).alias("e"))
    steps = ends.groupBy("tid", "seg", F.col("e.at").alias("at")).agg(*[F.sum(F.col(k) * F.col("e.sign")).alias(k) for k in named])
    w = Window.partitionBy("tid", "seg").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = steps.select("tid", "at", *[F.sum(k).over(run).alias(k) for k in named], F.lead("at").over(w).alias("next")).filter("depth > 0 and next is not null")
    return runs.select("tid", F.explode(F.sequence(F.col("at").cast("int"), (F.col("next") - 1).cast("int"))).alias("p"), *named)


def block_spans(reads: DataFrame, keep: Sequence[str], cigar: str = "cigar", pos: str = "pos") -> DataFrame:
    """(keep, start, stop, is_del): the spans of aligned and of deleted blocks of each read, a row a block."""
    b = F.col("b")
    rows = reads.select(*keep, F.col(pos).alias("at"), F.explode(F.filter(R.blocks(R.cigar_elements(F.col(cigar))), lambda x: F.instr(F.lit("M=XD"), x["op"]) > 0)).alias("b"))
    return rows.filter(b["len"] > 0).select(*keep, (F.col("at") + b["ref0"]).alias("start"), (F.col("at") + b["ref0"] + b["len"] - 1).alias("stop"), (b["op"] == "D").alias("is_del"))


def zero_filled(covered: DataFrame, intervals: DataFrame, value: str = "depth") -> DataFrame:
    """Every position of (tid, start, stop) intervals, with 0 where nothing covers it."""
    at = intervals.filter("start <= stop").select("tid", F.explode(F.sequence("start", "stop")).alias("p"))
    return at.join(covered, ["tid", "p"], "left").select("tid", "p", F.coalesce(value, F.lit(0)).alias(value))


def base_counts(is_del: Column) -> list[Column]:
    """n_a, n_c, n_g, n_t, n_del, n_mq0, max_mapq over a pile's rows; '*' counts as A."""
    base = F.upper(F.col("base"))
    one = lambda x: F.count_if(~is_del & (base.isin("A", "*") if x == "A" else base == x))
    return [one("A").alias("n_a"), one("C").alias("n_c"), one("G").alias("n_g"), one("T").alias("n_t"), F.count_if(is_del).alias("n_del"), F.count_if(F.col("mapq") == 0).alias("n_mq0"), F.coalesce(F.max("mapq"), F.lit(0)).alias("max_mapq")]


def passes(min_base: int = 0, min_map: int = 0, deletions: bool = False, strand: str | None = None, no_mq0: bool = False) -> Column:
    """A pile row's filter, composed of the named ones; deleted positions skip the base quality test."""
    out = F.lit(True)
    if not deletions:
        out = out & ~F.col("is_del")
    out = out & (F.col("is_del") | (F.col("quality") >= min_base)) & (F.col("mapq") >= min_map)
    if no_mq0:
        out = out & (F.col("mapq") > 0)
    if strand:
        out = out & (~F.col("rev") if strand == "+" else F.col("rev"))
    return out


def mate_counts(reads: DataFrame, start: str = "pos", stop: str = "stop", name: str = "qid", keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Reads with ``mates``: 2 where another read of the contig has the name and overlaps the span, else 1.

    Sorted by start, a read overlaps an earlier one if that reaches its start, and a later one if
    the next begins before its stop; so whole reads are told apart before they are unnested.
    """
    w = Window.partitionBy(*keys, name).orderBy(start)
    reaches = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col(start)
    meets = F.lead(start).over(w) <= F.col(stop)
    return reads.withColumn("mates", F.when(F.coalesce(reaches, F.lit(False)) | F.coalesce(meets, F.lit(False)), 2).otherwise(1))


def overlap_filter(pile: DataFrame, order: Sequence[str], name: str = "qid", retain: bool | Column = False, keys: Sequence[str] = LOCUS, mates: str = "mates") -> DataFrame:
    """Of the reads of one name at a locus at most one stays, decided in ``order``.

    Equal bases keep the higher quality (the earlier on a tie). Unequal bases drop both and forget
    the name, or with ``retain`` keep the later one if it differs from the reference. Rows whose
    span no other read of that name overlaps pass untouched; only the others are folded, a few rows
    a group.
    """
    retain = F.lit(retain) if isinstance(retain, bool) else retain
    cols = pile.columns
    alone, shared = pile.filter(F.col(mates) <= 1), pile.filter(F.col(mates) > 1).withColumn("keep_mismatch", retain)
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*cols).alias("row"), "keep_mismatch")
    groups = shared.groupBy(*keys, name).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def fold(a: Column, x: Column) -> Column:
        differ = F.when(x["keep_mismatch"], F.when(x["row"]["base"] != x["row"]["ref"], x).otherwise(a))
        return F.when(a.isNull(), x).when(a["row"]["base"] != x["row"]["base"], differ).when(a["row"]["quality"] < x["row"]["quality"], x).otherwise(a)

    first = F.element_at("rows", 1)
    kept = groups.select(F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), first, fold).alias("r")).filter("r is not null").select("r.row.*")
    return alone.unionByName(kept.select(*cols))


def gap_event(elements: Column, offset: Column, near: int = 5) -> Column:
    """I or D: the first insertion or deletion within ``near`` of a read offset, else null. Every operation advances the walk."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("hit"))

    def step(a: Column, e: Column) -> Column:
        close = e["op"].isin("I", "D") & (F.abs(a["at"] - offset) <= near)
        return F.struct((a["at"] + e["len"]).alias("at"), F.coalesce(a["hit"], F.when(close, e["op"])).alias("hit"))

    return F.aggregate(elements, start, step, lambda a: a["hit"])


def quality_histogram(pile: DataFrame, keys: Sequence[str] = LOCUS, also: Sequence[str] = ()) -> DataFrame:
    """(keys, hist): array<struct<base, q, n>> of a locus, bounded by bases x qualities, not by depth."""
    counted = pile.groupBy(*keys, *also, "base", "quality").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys, *also).agg(F.collect_list(F.struct("base", F.col("quality").alias("q"), "n")).alias("hist"))


def window_mismatch_quality(rows: DataFrame, keys: Sequence[str], at: Column, reach: int = 150) -> DataFrame:
    """Sum of qualities of mismatching bases within ``reach`` of a site, for each key."""
    near = F.abs(F.col("p") - at) <= reach
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(near & (F.col("base") != F.col("ref")), F.col("quality"))), F.lit(0)).alias("mismatch_quality"))


def indel_ahead(elements: Column) -> Column:
    """array<struct<ref0, length>>: the indel that follows the base before it (insertions positive)."""
    b = R.blocks(elements)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(b) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(b, i).alias("x"), F.try_element_at(b, i + 1).alias("y")))
    hits = F.filter(pairs, lambda v: F.instr(F.lit("M=X"), v["x"]["op"]) > 0)
    hits = F.filter(hits, lambda v: F.coalesce(v["y"]["op"].isin("I", "D"), F.lit(False)))
    return F.transform(hits, lambda v: F.struct((v["y"]["ref0"] - 1).alias("ref0"), F.when(v["y"]["op"] == "I", v["y"]["len"]).otherwise(-v["y"]["len"]).alias("length")))
