"""Alignments read from a sales table: a deterministic stand-in for reads, with a SQL twin.

Each line item is a read of one M block; its quality is constant and its bases follow from a rule,
so whole pileups can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("pos", "qid", "partkey", "suppkey", "price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    mapq = F.round(F.col("l_tax") * 100).cast("int") * 7
    rev, dup = F.col("l_linestatus") == "F", F.col("l_suppkey") % 17 == 0
    bit = lambda c, v: F.when(c, v).otherwise(0)
    flag = bit(F.col("l_partkey") % 5 != 0, 1) + bit(F.col("l_partkey") % 3 != 0, 2) + bit(mapq == 0, 4) + bit(F.col("l_partkey") % 11 == 0, 8) + bit(rev, 16) + bit(F.col("l_suppkey") % 2 == 0, 32) + bit(F.col("l_suppkey") % 13 == 0, 256) + bit(F.col("l_suppkey") % 19 == 0, 512) + bit(dup, 1024)
    n = F.col("l_quantity").cast("int")
    half = F.floor(n / 2).cast("int")
    gap = (F.col("l_suppkey") % 3).cast("int")
    piece = lambda k, op: F.when(k > 0, F.concat(k.cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(piece((F.col("l_partkey") % 4).cast("int"), "S"), piece(half, "M"), piece(F.lit(1) + gap, "D"), piece((F.col("l_partkey") % 3).cast("int"), "I"), piece(n - half, "M"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), (F.col("l_linenumber") - 1).cast("int").alias("tid"), day.alias("pos"), n.alias("len"), mapq.alias("mapq"),
        (2 + F.col("l_partkey") % 40).cast("int").alias("quality"), rev.alias("rev"), dup.alias("dup"), F.when(F.col("l_returnflag") == "N", "NORMAL").otherwise("TUMOR").alias("sample"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_extendedprice").alias("price"), flag.cast("int").alias("flag"), cigar.alias("cigar"),
        (day + (F.col("l_partkey") % 60).cast("int") - 20).alias("mate_pos"), ((F.col("l_suppkey") % 300).cast("int") - 150).alias("isize"),
    )


def ref_base(tid: Column, p: Column, step: int = 0) -> Column:
    return F.substring(F.lit("ACGT"), ((tid * 7 + p * 3 + step) % 4 + 1).cast("int"), F.lit(1))


def pile(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of reads unnested over positions: p, base, ref, quality, mapq, rev, sample, order columns, ``keep``."""
    cols = list(dict.fromkeys(["tid", "qid", "pos", "len", "partkey", "suppkey", "price", "mapq", "quality", "rev", "sample", *keep]))
    out = rows.select(*cols, F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("p"))
    odd = (F.col("partkey") * 31 + F.col("p")) % 23 == 0
    return out.withColumn("ref", ref_base(F.col("tid"), F.col("p"))).withColumn("base", F.when(odd, ref_base(F.col("tid"), F.col("p"), 1)).otherwise(F.col("ref"))).withColumn("is_del", F.lit(False))


def mismatches(rows: DataFrame, *keep: str) -> DataFrame:
    """The pile's rows whose base differs from the reference, without the others ever being unnested: p and the columns named."""
    first = F.col("pos") + F.pmod(-(F.col("partkey") * 31 + F.col("pos")), F.lit(23))
    stop = F.col("pos") + F.col("len") - 1
    some = rows.select("tid", *keep, first.cast("int").alias("m_first"), stop.cast("int").alias("m_stop")).filter("m_first <= m_stop")
    return some.select("tid", *keep, F.explode(F.sequence("m_first", "m_stop", F.lit(23))).alias("p"))


#: the same in SQL: WITH <READS>, <PILE> SELECT ...
READS = """reads AS (SELECT *, cast((CASE WHEN partkey % 4 > 0 THEN (partkey % 4) || 'S' ELSE '' END) || (CASE WHEN len // 2 > 0 THEN (len // 2) || 'M' ELSE '' END) || (1 + suppkey % 3) || 'D'
      || (CASE WHEN partkey % 3 > 0 THEN (partkey % 3) || 'I' ELSE '' END) || (len - len // 2) || 'M' AS VARCHAR) AS cigar,
      CAST((CASE WHEN partkey % 5 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN partkey % 3 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN mapq = 0 THEN 4 ELSE 0 END) + (CASE WHEN partkey % 11 = 0 THEN 8 ELSE 0 END)
      + (CASE WHEN rev THEN 16 ELSE 0 END) + (CASE WHEN suppkey % 2 = 0 THEN 32 ELSE 0 END) + (CASE WHEN suppkey % 13 = 0 THEN 256 ELSE 0 END) + (CASE WHEN suppkey % 19 = 0 THEN 512 ELSE 0 END) + (CASE WHEN dup THEN 1024 ELSE 0 END) AS INT) AS flag,
      CAST(pos + partkey % 60 - 20 AS INT) AS mate_pos, CAST(suppkey % 300 - 150 AS INT) AS isize FROM
    (SELECT l_orderkey * 10 + l_linenumber AS qid, CAST(l_linenumber - 1 AS INT) AS tid, CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS INT) AS pos, CAST(l_quantity AS INT) AS len,
      CAST(round(l_tax * 100) AS INT) * 7 AS mapq, CAST(2 + l_partkey % 40 AS INT) AS quality, l_linestatus = 'F' AS rev, l_suppkey % 17 = 0 AS dup,
      CASE WHEN l_returnflag = 'N' THEN 'NORMAL' ELSE 'TUMOR' END AS sample, l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS price FROM lineitem))"""


def pile_sql(where: str = "NOT dup") -> str:
    return f"""pile AS (SELECT *, substr('ACGT', CAST(1 + (tid * 7 + p * 3) % 4 AS INT), 1) AS ref,
      substr('ACGT', CAST(1 + (tid * 7 + p * 3 + (CASE WHEN (partkey * 31 + p) % 23 = 0 THEN 1 ELSE 0 END)) % 4 AS INT), 1) AS base
      FROM (SELECT *, CAST(unnest(generate_series(pos, pos + len - 1)) AS INT) AS p FROM reads WHERE {where}))"""
