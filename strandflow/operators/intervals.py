"""Interval algebra over closed (key, start, stop) intervals, and binned range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 13


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") <= F.col(f"{b}.stop")) & (F.col(f"{b}.start") <= F.col(f"{a}.stop"))


def contiguous(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Overlap or abut."""
    return (a_start - 1 <= b_stop) & (b_start - 1 <= a_stop)


def is_past(a_key: Column, a_start: Column, b_key: Column, b_stop: Column) -> Column:
    return (a_key > b_key) | ((a_key == b_key) & (a_start > b_stop))


def is_before(a_key: Column, a_stop: Column, b_key: Column, b_start: Column) -> Column:
    return (a_key < b_key) | ((a_key == b_key) & (a_stop < b_start))


def merge_pair(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """The union of two contiguous intervals; null where they aren't."""
    joined = F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_stop, b_stop).alias("stop"))
    return F.when(contiguous(a_start, a_stop, b_start, b_stop), joined)


def valid(contig_length: Column, start: Column, stop: Column) -> Column:
    """1-based bounds inside a known contig."""
    return F.coalesce((stop >= start) & (start >= 1) & (stop <= contig_length), F.lit(False))


def shift_in(df: DataFrame, start: str = "start", stop: str = "stop", padding: int = 0) -> DataFrame:
    """1-based closed bounds to 0-based, padded; not clipped."""
    return df.withColumn(start, F.col(start) - 1 - padding).withColumn(stop, F.col(stop) - 1 + padding)


def merge(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop", segment: int | None = 1 << 20) -> DataFrame:
    """Union of contiguous intervals of each key: (keys, start, stop).

    Islands by a running maximum. A key with very many intervals is first merged inside segments of
    ``segment`` positions (by start), which leaves few intervals for the pass over the whole key.
    """

    def islands(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start, stop)
        before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
        flagged = rows.withColumn("i_new", F.coalesce((F.col(start) - 1 > before).cast("int"), F.lit(1)))
        numbered = flagged.withColumn("i_no", F.sum("i_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "i_no").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("i_no")

    rows = df.select(*keys, start, stop)
    if segment:
        rows = islands(rows.withColumn("i_seg", F.floor(F.col(start) / segment)), [*keys, "i_seg"]).drop("i_seg")
    return islands(rows, keys)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_stop: str, r_start: str, r_stop: str, how: str = "inner", width: int = BIN) -> DataFrame:
    """Rows of both sides whose closed intervals overlap on equal keys; ``how`` is inner, left_semi or left_anti.

    Both sides are unnested over bins and joined on (keys, bin), an equi-join that shuffles or
    broadcasts as any other; a pair that shares several bins counts in the first of them.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    r = right.filter(F.col(r_start) <= F.col(r_stop)).withColumn("j_bin", bins(r_start, r_stop))
    first = lambda: F.col("j_bin") == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width)
    hit = (F.col(l_start) <= F.col(r_stop)) & (F.col(r_start) <= F.col(l_stop))
    if how == "inner":
        l = left.filter(F.col(l_start) <= F.col(l_stop)).withColumn("j_bin", bins(l_start, l_stop))  # noqa: E741
        return l.join(r, [*keys, "j_bin"]).filter(hit & first()).drop("j_bin")
    cols = left.columns
    l = left.withColumn("j_id", F.struct(*[F.col(c) for c in cols]))  # noqa: E741
    # one bin suffices for a short left row; longer ones are unnested and folded to one again
    narrow = r.select(*keys, "j_bin", r_start, r_stop).distinct()
    short = F.floor(F.col(l_start) / width) == F.floor(F.col(l_stop) / width)
    one = l.filter(short).withColumn("j_bin", F.floor(F.col(l_start) / width))
    cond = [one[k] == narrow[k] for k in [*keys, "j_bin"]]
    cond = cond[0] if len(cond) == 1 else __import__("functools").reduce(lambda a, b: a & b, cond)
    out = one.join(narrow, cond & (one[l_start] <= narrow[r_stop]) & (narrow[r_start] <= one[l_stop]), how).select(*cols)
    long_ = l.filter(~short & (F.col(l_start) <= F.col(l_stop)))
    own = list(dict.fromkeys([*keys, l_start, l_stop]))  # not row numbers, which may differ when rows are worked out again
    many = long_.select(*own).distinct().withColumn("j_bin", bins(l_start, l_stop))
    hits = many.join(narrow, [*keys, "j_bin"]).filter(hit).select(*own).distinct()
    return out.unionByName(long_.join(hits, own, how).select(*cols))


def first_match(left: DataFrame, marks: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Left outer join to the first mark of each key in ``order`` (min_by: a partial aggregate, no window)."""
    best = marks.groupBy(*keys).agg(F.min_by(F.struct(*carry), F.struct(*order)).alias("m_first")).select(*keys, *[F.col(f"m_first.{c}").alias(c) for c in carry])
    return left.join(best, list(keys), "left")


def lookup_with_default(left: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, value: str, default: Column) -> DataFrame:
    """``value`` of the range that holds a position, the smallest start first, else the default.

    Rows meet their range by keys and position: row numbers may differ when rows are worked out again.
    """
    points = left.select(*keys, at).distinct().withColumn("l_at", F.col(at))
    hits = range_join(points, ranges.select(*keys, start, stop, value), keys, at, "l_at", start, stop)
    best = hits.groupBy(*keys, at).agg(F.min_by(value, start).alias(value))
    return left.join(best, [*keys, at], "left").select(*left.columns, F.coalesce(F.col(value), default).alias(value))


def out_of_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is under the one before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("o_before", F.lag(value).over(w)).filter(F.col(value) < F.col("o_before")).drop("o_before")


def chunks(contigs: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Fixed windows of (tid, length) contigs: (tid, chunk, start, stop, fetch_start, fetch_stop)."""
    k = contigs.select("tid", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("chunk"))
    start, stop = F.col("chunk") * size, F.least((F.col("chunk") + 1) * size, F.col("length")) - 1
    return k.select("tid", "chunk", start.alias("start"), stop.alias("stop"), F.greatest(start - halo, F.lit(0)).alias("fetch_start"), F.least(stop + halo, F.col("length") - 1).alias("fetch_stop"))
