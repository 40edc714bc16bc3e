"""Interval lists, BED and position files, FASTA, ploidy, pedigree and quality-statistics text."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import valid


def interval_list(spark: SparkSession, path: str, dictionary: DataFrame | None = None, padding: int = 0) -> DataFrame:
    """(contig, start, stop, strand, name) 0-based closed, padded; malformed lines and those outside the dictionary are skipped."""
    return intervals_of(spark.read.text(path), dictionary, padding)


def intervals_of(lines: DataFrame, dictionary: DataFrame | None = None, padding: int = 0) -> DataFrame:
    if dictionary is None:
        head = lines.filter(F.col("value").startswith("@SQ"))
        dictionary = head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("length"))
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@")).filter((F.size(f) == 5) & F.get(f, F.lit(1)).rlike("^[0-9]+$") & F.get(f, F.lit(2)).rlike("^[0-9]+$") & F.get(f, F.lit(3)).isin("+", "-"))
    rows = rows.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("stop"), F.get(f, F.lit(3)).alias("strand"), F.get(f, F.lit(4)).alias("name"))
    ok = rows.join(dictionary.select("contig", "length"), "contig").filter(valid(F.col("length"), F.col("start"), F.col("stop")))
    return ok.select("contig", (F.col("start") - 1 - padding).alias("start"), (F.col("stop") - 1 + padding).alias("stop"), "strand", "name")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, beg, end) half-open. Two numbers are BED, one is a 1-based position; blank, #, browser and track lines are skipped."""
    return bed_of(spark.read.text(path))


def bed_of(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|browser\b|track\b)"))
    two = (F.size(f) >= 3) & F.try_element_at(f, F.lit(3)).rlike("^[0-9]+$")
    beg = F.when(two, F.get(f, F.lit(1)).cast("long")).otherwise(F.get(f, F.lit(1)).cast("long") - 1)
    end = F.when(two, F.try_element_at(f, F.lit(3)).try_cast("long")).otherwise(F.get(f, F.lit(1)).cast("long"))
    out = rows.select(F.get(f, F.lit(0)).alias("contig"), beg.alias("beg"), end.alias("end"), "value")
    fail = F.raise_error(F.concat(F.lit("end before begin: "), "value")).cast("long")
    return out.select("contig", "beg", F.when(F.col("end") < F.col("beg"), fail).otherwise(F.col("end")).alias("end"))


def tab_regions(spark: SparkSession, path: str) -> DataFrame:
    """(contig, beg, end) 0-based closed from 1-based TAB lines with an optional end."""
    return tab_regions_of(spark.read.text(path))


def tab_regions_of(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(F.get(f, F.lit(0)).alias("contig"), (F.get(f, F.lit(1)).cast("long") - 1).alias("beg"), (F.coalesce(F.try_element_at(f, F.lit(3)).try_cast("long"), F.get(f, F.lit(1)).cast("long")) - 1).alias("end"))


def region_file(spark: SparkSession, path: str) -> DataFrame:
    """BED by its extension, else TAB; (contig, start, stop) 0-based closed."""
    if path.endswith((".bed", ".bed.gz", ".bed.bgz")):
        return bed(spark, path).select("contig", F.col("beg").alias("start"), (F.col("end") - 1).alias("stop"))
    return tab_regions(spark, path).select("contig", F.col("beg").alias("start"), F.col("end").alias("stop"))


def dictionary_path(reference: str) -> str:
    """The .dict beside a FASTA file: x.dict, else x.fa.dict."""
    for ext in (".fasta", ".fa", ".fna", ".txt"):
        for tail in (ext, ext + ".gz"):
            if reference.endswith(tail):
                first = reference[: -len(tail)] + ".dict"
                return first if os.path.exists(first) else reference + ".dict"
    raise ValueError(f"unsupported reference: {reference}")


def fasta(spark: SparkSession, path: str, chunk: int = 4096) -> DataFrame:
    """(contig, chunk, bases): the sequence in equal chunks, upper and lower case kept.

    Each line finds its contig and offset by prefix sums over lines; chunks are put together by key,
    so no contig passes through one row.
    """
    return fasta_of(spark.read.text(path), chunk)


def fasta_of(lines: DataFrame, chunk: int = 4096) -> DataFrame:
    lines = lines.select(F.monotonically_increasing_id().alias("i"), F.trim("value").alias("v"))
    order = Window.partitionBy(F.lit(0)).orderBy("i")
    named = lines.withColumn("n", F.sum(F.col("v").startswith(">").cast("int")).over(order))
    heads = named.filter(F.col("v").startswith(">")).select("n", F.regexp_extract("v", r"^>(\S+)", 1).alias("contig"))
    w = Window.partitionBy("n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    body = named.filter(~F.col("v").startswith(">") & (F.col("v") != "")).withColumn("at", F.coalesce(F.sum(F.length("v")).over(w), F.lit(0)))
    parts = body.join(heads, "n").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("v") - 1) / chunk))))
    lo = F.greatest(F.col("chunk") * chunk - F.col("at"), F.lit(0)).cast("int")
    piece = F.substring("v", lo + 1, (F.least(F.length("v"), (F.col("chunk") + 1) * chunk - F.col("at")) - lo).cast("int"))
    cut = parts.select("contig", F.col("chunk").cast("int").alias("chunk"), "at", piece.alias("piece"))
    return cut.groupBy("contig", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("bases"))


def fetch(reference: DataFrame, wanted: DataFrame, chunk: int = 4096) -> DataFrame:
    """``wanted`` (contig, start, stop; 0-based closed) with its bases: an equi-join on the chunks each range touches."""
    rows = wanted.withColumn("f_id", F.monotonically_increasing_id()).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("stop") / chunk)))).withColumn("chunk", F.col("chunk").cast("int"))
    lo = F.greatest(F.col("start") - F.col("chunk") * chunk, F.lit(0)).cast("int")
    piece = F.substring("bases", lo + 1, (F.least(F.lit(chunk), F.col("stop") - F.col("chunk") * chunk + 1) - lo).cast("int"))
    got = rows.join(reference, ["contig", "chunk"]).select("f_id", "chunk", piece.alias("piece")).groupBy("f_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("bases"))
    return wanted.withColumn("f_id", F.monotonically_increasing_id()).join(got, "f_id", "left").drop("f_id")


def sequence_lengths(reference: DataFrame) -> DataFrame:
    return reference.groupBy("contig").agg(F.sum(F.length("bases")).alias("length"))


def ploidy_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, defaults) of 'CHROM FROM TO SEX PLOIDY' lines; * is a sex's default."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("stop"), F.get(f, F.lit(3)).alias("sex"), F.get(f, F.lit(4)).cast("int").alias("ploidy"))
    return rows.filter("contig != '*'").withColumn("start", F.col("start") - 1).withColumn("stop", F.col("stop") - 1), rows.filter("contig = '*'").select("sex", "ploidy")


def families(lines: DataFrame) -> DataFrame:
    """(sample, father, mother, sex) of pedigree lines with both parents known."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.size(f) >= 5).select(F.get(f, F.lit(1)).alias("sample"), F.get(f, F.lit(2)).alias("father"), F.get(f, F.lit(3)).alias("mother"), F.when(F.get(f, F.lit(4)) == "1", "M").otherwise("F").alias("sex"))
    return rows.filter("father != '0' and mother != '0'")


def statistics(spark: SparkSession, paths: Sequence[str], producer: str | None = None) -> DataFrame:
    """(file_no, section, key, values) of sectioned statistics: SN rows have a key and one value, others an array.

    With ``producer`` a file whose first line lacks it is an error.
    """
    out = None
    for no, path in enumerate(paths):
        lines = spark.read.text(path)
        if producer is not None:
            first = lines.limit(1).collect()
            if not first or producer not in first[0]["value"]:
                raise ValueError(f"not written by {producer}: {path}")
        part = sections_of(lines).select(F.lit(no).alias("file_no"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def sections_of(lines: DataFrame) -> DataFrame:
    """(section, key, values) of statistics text."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(f) > 1))
    sn = F.get(f, F.lit(0)) == "SN"
    nums = lambda a: F.transform(a, lambda x: F.regexp_extract(x, r"^-?[0-9.]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double"))
    return rows.select(F.get(f, F.lit(0)).alias("section"), F.when(sn, F.regexp_replace(F.get(f, F.lit(1)), ":$", "")).otherwise(F.get(f, F.lit(1))).alias("key"), F.when(sn, nums(F.slice(f, 3, 1))).otherwise(nums(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))))).alias("values"))
