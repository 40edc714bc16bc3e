"""Exact deduplication over a log-structured merge index of text digests (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, done_with, filter_bits, has_bit, materialize, may_be_in, place


def normalise(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtables: int = 4) -> tuple[DataFrame, DataFrame]:
    """The index: (entries, hits).

    entries: (doc_id, d), a row per document. hits: (d, text, keep_id, group_size) for every text
    that occurs more than once, compared byte by byte; ``text`` is null unless texts that differ
    share the digest (then the lookup needs the text as well).

    Rows go to ``memtables`` level-0 memtables by a hash of doc_id. A memtable flushes a run: its
    digests, sorted, each with the smallest identifier and the number of rows, and a bit filter of so
    many bits for each digest. Compaction takes only digests that repeat in a run or that another
    run's filter may hold, and keeps the smallest identifier. Hits are then grouped by digest and whole text, which
    compares bytes; equal texts collapse before the shuffle, so a huge group costs a row a task.
    Texts that no other equals stay where they are, behind a filter of at most 32 MB; with more than
    some 16 million repeated digests it lets some of them into that shuffle, and loses none.
    """
    keyed = docs.select("doc_id", normalise(F.col("text")).alias("t")).select("doc_id", digest(F.col("t")).alias("d"), F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run"))
    entries = materialize(keyed, "entries")
    runs = materialize(entries.groupBy("run", "d").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("run", "d"), "runs")

    # the filters grow with the runs; they meet the entries block by block, broadcast only where Spark finds them small
    bits = filter_bits(runs.count() // memtables, most=1 << 46)
    placed = place(runs, F.col("d"), bits)
    filters = placed.groupBy("run", "f_block").agg(F.bitmap_construct_agg("f_bit").alias("f_map"))
    filters = filters.groupBy("f_block").agg(F.collect_list(F.struct("run", "f_map")).alias("maps"))
    other = F.exists("maps", lambda m: (m["run"] != F.col("run")) & has_bit(m["f_map"], F.col("f_bit")))
    compacted = placed.join(filters, "f_block").filter((F.col("n") > 1) | other).groupBy("d").agg(F.min("least").alias("least"), F.sum("n").alias("n")).filter("n > 1")
    compacted = materialize(compacted, "compacted")
    done_with(runs)

    bits = filter_bits(compacted.count())
    texts = docs.select("doc_id", normalise(F.col("text")).alias("t")).withColumn("d", digest(F.col("t")))
    texts = may_be_in(texts, F.col("d"), bit_filter(compacted, F.col("d"), bits), bits)
    groups = texts.groupBy("d", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.join(compacted.select("d"), "d", "left_semi"), "verified")
    variants = groups.groupBy("d").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    hits = groups.join(variants, "d").select("d", F.when(F.col("mixed"), F.col("t")).alias("text"), "keep_id", "group_size")
    return entries.select("doc_id", "d"), materialize(hits, "hits")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtables: int = 4) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), a row per document.

    Of equal texts the smallest doc_id stays. A null text equals an empty one; an empty table gives
    no rows. A null doc_id never stays unless its group has no other. Rows that repeat a doc_id and
    its text carry the same decision, as doc_id names them. Texts that differ under one digest
    (a collision) stay apart, as bytes decide. Other columns are not read.
    """
    entries, hits = classes(docs, digest, memtables)
    plain = hits.filter("text is null").select("d", "keep_id", "group_size")
    mixed = hits.filter("text is not null")
    by_digest = entries.join(plain, "d", "left")
    if not mixed.isEmpty():
        # only digests that texts share by accident: looked up by digest and text
        texts = docs.select("doc_id", normalise(F.col("text")).alias("text")).withColumn("d", digest(F.col("text")))
        apart = texts.join(mixed, ["d", "text"]).select("d", "doc_id", "keep_id", "group_size")
        by_digest = by_digest.join(mixed.select("d").distinct(), "d", "left_anti").unionByName(apart)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return by_digest.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("d").alias("digest"))


def drop_exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Documents that stay, all their columns, one row for each text.

    Of equal texts the row with the smallest doc_id stays, a null one only where there is no other.
    Rows with the same doc_id (null too) and equal texts are copies: the text that one of them holds
    stays once, in the row that is least by its columns' hash. Rows that share a doc_id but not a
    text are decided each by its own text. Only rows whose doc_id has something to drop are matched,
    behind a bit filter, so texts that stay are not shuffled. Digests that collide are told apart by
    the text.
    """
    entries, hits = classes(docs, digest)
    many = hits.select("d", F.coalesce("text", F.lit("")).alias("k_text"), F.col("text").isNotNull().alias("mixed"), "keep_id")
    by_digest = many.groupBy("d").agg(F.max("mixed").alias("mixed"), F.min("keep_id").alias("keep_id"))
    lost = F.coalesce(~F.col("mixed") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False))
    flags = entries.join(by_digest, "d", "left").groupBy("doc_id").agg(F.every(lost).alias("gone"), F.some(F.col("mixed").isNotNull()).alias("has")).filter("has")
    touched = materialize(flags.select("doc_id", "gone"), "touched")
    bits = filter_bits(touched.count())
    rows = place(docs.select("doc_id", "text", F.struct("*").alias("row")), F.col("doc_id"), bits)
    probe = rows.join(F.broadcast(bit_filter(touched, F.col("doc_id"), bits)), "f_block", "left").withColumn("f_hit", has_bit(F.col("f_map"), F.col("f_bit"))).drop("f_map")
    clear = probe.filter(~F.col("f_hit")).select("row")
    # most copies go by their doc_id alone; the few rows left are matched by their text's digest
    left = probe.filter("f_hit").join(touched.filter("gone").select("doc_id"), "doc_id", "left_anti")
    seen = left.withColumn("t", normalise(F.col("text"))).withColumn("d", digest(F.col("t"))).select("doc_id", "row", "d", "t")
    mixed = many.filter("mixed").select("d").distinct()
    # the text takes part only where texts share a digest by accident
    key = F.when(F.col("m_d").isNotNull(), F.col("t")).otherwise("")
    seen = seen.join(mixed.select(F.col("d").alias("m_d")), F.col("d") == F.col("m_d"), "left").withColumn("k_text", key).drop("t", "m_d")
    named = seen.join(many.withColumn("found", F.lit(True)), ["d", "k_text"], "left")
    single = named.filter("found is null").select("row")
    stays = named.filter(F.col("found") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = stays.groupBy("d", "k_text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return clear.unionByName(single).unionByName(stays.select("row")).select("row.*")
