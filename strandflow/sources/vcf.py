"""Variant text: scan, header, region filter and typed INFO columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vcf_info


def parse(lines: DataFrame, keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """contig, pos (0-based), id, ref, alt (array), qual, filter (array), info (map), format, calls; malformed lines are dropped."""
    f = F.split(value, "\t")
    ok = (F.size(f) >= 8) & F.get(f, F.lit(1)).rlike("^[0-9]+$")
    none = lambda c: F.when(c != ".", c)
    rows = lines.filter(~F.col(value).startswith("#")).filter(ok)
    items = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    return rows.select(
        *keep, F.get(f, F.lit(0)).alias("contig"), (F.get(f, F.lit(1)).cast("int") - 1).alias("pos"), none(F.get(f, F.lit(2))).alias("id"), F.get(f, F.lit(3)).alias("ref"), items(F.get(f, F.lit(4)), ",").alias("alt"), none(F.get(f, F.lit(5))).try_cast("float").alias("qual"),
        items(F.get(f, F.lit(6)), ";").alias("filter"), vcf_info(F.get(f, F.lit(7))).alias("info"), F.when(F.size(f) > 8, F.split(F.get(f, F.lit(8)), ":")).alias("format"), F.when(F.size(f) > 9, F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(1))), lambda c: F.split(c, ":"))).alias("calls"),
    )


def scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse(spark.read.text(path))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, number, type, description) of the ## declarations."""
    lines = spark.read.text(path).filter(F.col("value").startswith("##") & F.col("value").contains("=<"))
    field = lambda name: F.regexp_extract("value", rf"[<,]{name}=(\"[^\"]*\"|[^,>]*)", 1)
    return lines.select(F.regexp_extract("value", "^##([^=]+)=", 1).alias("kind"), field("ID").alias("id"), field("Number").alias("number"), field("Type").alias("type"), F.regexp_replace(field("Description"), '"', "").alias("description"))


def samples(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("f")).limit(1).collect()
    return rows[0]["f"][9:] if rows else []


def region(variants: DataFrame, contig: str, begin: int, stop: int) -> DataFrame:
    """Records whose position lies in the closed 0-based [begin, stop]; a long deletion counts at its anchor."""
    return variants.filter((F.col("contig") == contig) & F.col("pos").between(begin, stop))


def info_columns(variants: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns for INFO keys; flag becomes a boolean, missing values null."""
    cols = [F.map_contains_key("info", F.lit(k)).alias(k) if t == "flag" else F.col("info")[k].try_cast(t).alias(k) for k, t in types.items()]
    return variants.select("*", *cols)
