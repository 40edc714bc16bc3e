"""Merging and summarising sectioned read-quality statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_numbers(rows: DataFrame, how: dict[str, str], key: str = "key", value: str = "value", order: str = "file_no") -> DataFrame:
    """(key, value): per key sum, min or max as ``how`` says; other keys keep the first file's value."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in how.items() for x in kv]), F.col(key)), F.lit("first")) if how else F.lit("first")
    agg = rows.groupBy(key).agg(F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by(value, order).alias("one"))
    return agg.select(key, F.when(kind == "sum", F.col("s")).when(kind == "min", F.col("lo")).when(kind == "max", F.col("hi")).otherwise(F.col("one")).alias(value))


def add_matrices(rows: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """Element-wise sums of ragged arrays of one key; missing rows and cells count as 0."""
    cells = rows.select(*keys, F.posexplode(values).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias(values))


def weighted(value: str, weight: str) -> list[Column]:
    """mean and population standard deviation of a histogram."""
    w, x = F.col(weight), F.col(value)
    mean = F.sum(x * w) / F.sum(w)
    return [mean.alias("mean"), F.sqrt(F.greatest(F.sum(w * x * x) / F.sum(w) - mean * mean, F.lit(0.0))).alias("sd")]


def histogram_percentile(rows: DataFrame, keys: Sequence[str], index: str, count: str, percents: Sequence[float]) -> DataFrame:
    """(keys, p..): the first index whose running count reaches k = int(p (N + 1) / 100); 0 where k <= 0, the last index where k >= N."""
    w = Window.partitionBy(*keys).orderBy(index)
    run = rows.select(*keys, index, F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c_run"), F.sum(count).over(Window.partitionBy(*keys)).alias("c_all"))
    out = []
    for p in percents:
        k = F.floor(F.lit(p) * (F.col("c_all") + 1) / 100)
        pick = F.min(F.when((k < F.col("c_all")) & (F.col("c_run") >= k), F.col(index)))
        out.append(F.when(F.first(k) <= 0, F.lit(0)).when(F.first(k) >= F.first("c_all"), F.max(index)).otherwise(pick).alias(f"p{p:g}"))
    return run.groupBy(*keys).agg(*out)


def quality_bands(counts: Column) -> Column:
    """Mismatch counts by quality (index 0 is N): bands over 30, 30..21, 20..11, up to 10, N; index 31 is in the first two."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda lo, hi: total(F.slice(counts, F.lit(lo + 1), F.lit(hi - lo + 1)))
    return F.struct(total(F.slice(counts, F.lit(32), F.greatest(F.size(counts) - 31, F.lit(0)))).alias("over30"), part(21, 31).alias("q21_30"), part(11, 20).alias("q11_20"), part(1, 10).alias("to10"), part(0, 0).alias("n"))


def indel_ratio(insertions: Column, deletions: Column) -> Column:
    return F.coalesce(F.try_divide(insertions, deletions), F.lit(0.0))


def nearest_ticks(rows: DataFrame, keys: Sequence[str], gc: str, ticks: Sequence[int], carry: str) -> DataFrame:
    """For each tick the ``carry`` of the row whose gc lies nearest to it (the smaller gc on a tie)."""
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(carry), F.struct(F.abs(F.col(gc) - t), F.col(gc))).alias(f"at{t}") for t in ticks])


def normalised(rows: DataFrame, value: str, keys: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Rows with a value over the largest of its group, of all rows without keys."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("top")) if keys else rows.agg(F.max(value).alias("top"))
    joined = rows.join(top, list(keys)) if keys else rows.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn(name, F.try_divide(F.col(value), F.col("top"))).drop("top")


def peak(rows: DataFrame, keys: Sequence[str], index: str, count: str) -> DataFrame:
    """(keys, peak, height): the index of the highest count, the first of equals."""
    return rows.groupBy(*keys).agg(F.min_by(index, F.struct(-F.col(count), F.col(index))).alias("peak"), F.max(count).alias("height"))


def gc_of_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """(gc, freq): for each number of G and C in a line its percentage of the longest line, and how often it occurs over the commonest number.

    Lines without any take part in that, but are left out of the result.
    """
    counted = lines.select((F.length(text) - F.length(F.regexp_replace(text, "[GCgc]", ""))).alias("n"), F.length(text).alias("len"))
    per = counted.groupBy("n").agg(F.count(F.lit(1)).alias("lines"), F.max("len").alias("len"))
    whole = per.agg(F.max("len").alias("longest"), F.max("lines").alias("top"))  # one row
    return per.crossJoin(F.broadcast(whole)).filter("n > 0").select((F.col("n") * 100 / F.col("longest")).alias("gc"), (F.col("lines") / F.col("top")).alias("freq"))
