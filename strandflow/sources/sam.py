"""SAM text as a DataFrame, its header, region scans and read-group samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions.bases import decode_quality
from ..functions.text import header_tags


def header(spark: SparkSession, path: str) -> DataFrame:
    """(type, tags): the @ lines."""
    return header_of(spark.read.text(path))


def header_of(lines: DataFrame) -> DataFrame:
    lines = lines.filter(F.col("value").startswith("@"))
    kind = F.substring("value", 2, 2)
    return lines.select(kind.alias("type"), F.when(kind != "CO", header_tags(F.col("value"))).alias("tags"), F.col("value").alias("line"))


def contigs(head: DataFrame) -> DataFrame:
    """(tid, contig, length): ids by order in the header."""
    from pyspark.sql import Window

    sq = head.filter("type = 'SQ'").select(F.col("tags")["SN"].alias("contig"), F.col("tags")["LN"].cast("long").alias("length"), F.monotonically_increasing_id().alias("i"))
    return sq.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i")) - 1).cast("int").alias("tid"), "contig", "length")


def scan(spark: SparkSession, path: str | Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """Every record, unmapped ones too: positions 0-based, qualities as numbers, tags by name."""
    return records(spark.read.text(path), dictionary)


def records(lines: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    lines = lines.filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    tags = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.instr(t, ":") > 0)
    rows = lines.select(
        F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.when(F.get(f, F.lit(2)) != "*", F.get(f, F.lit(2))).alias("contig"), (F.get(f, F.lit(3)).cast("int") - 1).alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.when(F.get(f, F.lit(6)) == "=", F.when(F.get(f, F.lit(2)) != "*", F.get(f, F.lit(2)))).when(F.get(f, F.lit(6)) != "*", F.get(f, F.lit(6))).alias("mate_contig"), (F.get(f, F.lit(7)).cast("int") - 1).alias("mate_pos"), F.get(f, F.lit(8)).cast("int").alias("isize"), F.when(F.get(f, F.lit(9)) != "*", F.get(f, F.lit(9))).otherwise("").alias("seq"), decode_quality(F.get(f, F.lit(10))).alias("qual"),
        F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))).alias("tags"),
    )
    rows = rows.withColumn("stop", R.alignment_end(F.col("pos"), R.cigar_elements(F.col("cigar"))))
    if dictionary is not None:
        rows = rows.join(dictionary.select("contig", "tid"), "contig", "left")
    return rows


def region(reads: DataFrame, tid, begin: int, end: int, key: str = "tid") -> DataFrame:
    """Reads that overlap the half-open [begin, end)."""
    return reads.filter((F.col(key) == tid) & (F.col("pos") < end) & (F.col("stop") >= begin))


def regions(reads: DataFrame, wanted: Sequence[tuple], key: str = "tid") -> DataFrame:
    """Reads of each region in turn; a read in two regions comes twice. One scan: the region list is a literal."""
    kind = dict(reads.dtypes)[key]
    spans = F.array(*[F.struct(F.lit(k).cast(kind).alias("k"), F.lit(b).alias("b"), F.lit(e).alias("e")) for k, b, e in wanted])
    hits = F.filter(spans, lambda s: (s["k"] == F.col(key)) & (F.col("pos") < s["e"]) & (F.col("stop") >= s["b"]))
    return reads.withColumn("region", F.explode(hits)).drop("region")


def parse_region(text: str) -> tuple[str, int, int | None]:
    """chr, chr:a or chr:a-b (1-based, closed) to (contig, begin, end) 0-based half-open; end None: to the contig's end."""
    import re

    m = re.fullmatch(r"([^:]+)(?::([0-9,]+)(?:-([0-9,]+))?)?", text)
    if not m:
        raise ValueError(f"no region: {text}")
    a, b = (int(x.replace(",", "")) if x else None for x in m.groups()[1:])
    return m[1], (a or 1) - 1, b


def read_groups(head: DataFrame, file: str) -> DataFrame:
    """(file, rg, sample): the first of repeated ids; without any, the sample is the file; with exactly one, the file maps to it as well."""
    from pyspark.sql import Window

    rg = head.filter("type = 'RG'").select(F.col("tags")["ID"].alias("rg"), F.coalesce(F.col("tags")["SM"], F.lit(file)).alias("sample"), F.monotonically_increasing_id().alias("i"))
    own = rg.withColumn("n", F.row_number().over(Window.partitionBy("rg").orderBy("i"))).filter("n = 1").select(F.lit(file).alias("file"), "rg", "sample")
    whole = own.agg(F.count(F.lit(1)).alias("n"), F.first("sample").alias("s")).filter("n <= 1").select(F.lit(file).alias("file"), F.lit(None).cast("string").alias("rg"), F.coalesce("s", F.lit(file)).alias("sample"))
    return own.unionByName(whole)


def platform_groups(head: DataFrame, platforms: str) -> DataFrame:
    """Read groups whose platform occurs in the list of platforms."""
    return head.filter("type = 'RG'").filter(F.instr(F.lit(platforms), F.col("tags")["PL"]) > 0).select(F.col("tags")["ID"].alias("rg"))


def with_sample(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Reads with their sample: by (file, read group), else by the file alone; neither is an error."""
    named = groups.filter("rg is not null").select("file", "rg", F.col("sample").alias("s_rg"))
    whole = groups.filter("rg is null").select("file", F.col("sample").alias("s_file"))
    out = reads.join(named, ["file", "rg"], "left").join(whole, "file", "left")
    fail = F.raise_error(F.concat(F.lit("no sample for read group "), F.coalesce("rg", F.lit("?"))))
    return out.withColumn("sample", F.coalesce("s_rg", "s_file", fail.cast("string"))).drop("s_rg", "s_file")


def excluded_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("rg")).filter("rg != ''").distinct()


def path_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file, one a line, trailing white space cut."""
    out = [r["value"].rstrip() for r in spark.read.text(path).collect() if r["value"].strip()]
    if not out:
        raise ValueError(f"no paths in {path}")
    return out
