"""Shared helpers: scratch tables in the shared folder, fixed-size bit filters, cheap row digests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK_BITS = 32768  # bits that one bitmap_construct_agg value holds
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: scratch tables must be where every executor sees them")
        named = tempfile.mkdtemp(prefix="strandflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder belongs to the cluster
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def done_with(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more, and let Spark drop the shuffles that made them."""
    spark = None
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            spark = t.sparkSession
            discard(spark, path)
            _written.remove((spark, path))
    if spark is not None:
        spark.sparkContext._jvm.System.gc()  # the context cleaner follows the collector


def filter_bits(rows: int, bits_per_row: int = 16, most: int = 1 << 28) -> int:
    """Size of a bit filter: a power of two that grows with the rows, at most ``most`` bits (as a rule 32 MB).

    Beyond that it lets more rows pass that a join has to drop, and never loses one.
    """
    need = max(_BLOCK_BITS, rows * bits_per_row)
    return min(most, 1 << (need - 1).bit_length())


def bit_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """One bit per hashed key, as (block, map) rows; never over ``bits`` / 8 bytes."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.select((bit / _BLOCK_BITS).cast("int").alias("f_block"), F.pmod(bit, F.lit(_BLOCK_BITS)).alias("f_bit")).groupBy("f_block").agg(F.bitmap_construct_agg("f_bit").alias("f_map"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


def place(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """``df`` with the block and bit of its key in a filter of ``bits`` bits."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return df.withColumn("f_block", (bit / _BLOCK_BITS).cast("int")).withColumn("f_bit", F.pmod(bit, F.lit(_BLOCK_BITS)))


def may_be_in(df: DataFrame, key: Column, filt: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the filter: none that is in it gets lost, a few others pass.

    The filter is broadcast: its size is bounded by ``bits``, not by the data.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    out = df.columns
    probe = df.withColumn("f_block", (bit / _BLOCK_BITS).cast("int")).withColumn("f_bit", F.pmod(bit, F.lit(_BLOCK_BITS)))
    return probe.join(F.broadcast(filt), "f_block").filter(has_bit(F.col("f_map"), F.col("f_bit"))).select(*[F.col(f"`{c}`") for c in out])


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose doc_id is not among the distinct, non-null ones of ``gone``; only rows that a bit filter finds are shuffled."""
    bits = filter_bits(gone.count())
    out = df.columns
    placed = place(df, F.col("doc_id"), bits).join(F.broadcast(bit_filter(gone, F.col("doc_id"), bits)), "f_block", "left")
    placed = placed.withColumn("f_hit", has_bit(F.col("f_map"), F.col("f_bit"))).select(*out, "f_hit")
    return placed.filter(~F.col("f_hit")).select(*out).unionByName(placed.filter("f_hit").join(gone, "doc_id", "left_anti").select(*out))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside lambdas a plain expression would be repeated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def give_back() -> None:
    """Return what the driver's Python has freed to the system, after a model is fitted there."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))
