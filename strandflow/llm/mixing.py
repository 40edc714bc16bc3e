"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 s + 1); ties go to the earlier entry.

    The common divisor of the highest-quotient rule is bracketed first, which gives each entry a
    certain number of seats; the few left are then dealt one by one from a heap.
    """
    w = np.asarray(weights, float)
    got = np.zeros(len(w), np.int64)
    if seats <= 0 or not (w > 0).any():
        return got
    lo, hi = 0.0, 2 * w.sum() / seats + 2 * w.max()
    for _ in range(200):  # hi always gives too few or just enough seats
        mid = (lo + hi) / 2
        if np.floor(w / mid + 0.5).sum() <= seats:
            hi = mid
        else:
            lo = mid
    got = np.maximum(0, np.floor(w / hi * (1 - 1e-12) + 0.5).astype(np.int64))
    while got.sum() > seats:
        i = int(np.argmin(np.where(got > 0, w / (2 * got - 1), np.inf)))
        got[i] -= 1
    heap = [(-x / (2 * int(s) + 1), i) for i, (x, s) in enumerate(zip(w, got, strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * int(got[i]) + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words for each source: shares of all words by weight; at most ``most`` times its size, the excess reshared by weight."""
    total, out, left = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    room = total
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if room * weights[i] / w > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = room * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        room -= sum(out[i] for i in over)
        left = [i for i in left if i not in set(over)]
    return out


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block: int = 16, shard_words: int = 32768, max_shards: int = 65536, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes, spans): what the mix takes of each document.

    Sources in code point order, null last, weigh ``cycle`` in turn. Sizes are words of whole texts.
    Targets are apportioned into blocks of ``block`` words over all sources by Sainte-Laguë, and
    each source's blocks over its shards in the same way. A shard strings its documents together in
    seeded order; it is taken whole ``passes`` times, and the blocks left are a seeded circular run,
    so at most two documents of a shard are cut. ``spans`` are the word ranges of that run in the
    document: taken = passes * size + words in spans, never over ``most`` * size.

    Rows that agree in source, doc_id and size are copies: they are counted, and dealt evenly over
    the source's shards, so no shard is hot. The driver holds one number for each (source, shard): at
    most ``max_shards`` plus the number of sources; shards widen so that it stays so. Shards follow
    from hashes, so reruns agree. Null texts and empty tables take nothing. Other columns are not
    read.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sized")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s")).collect()  # a row a source
    order = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["s"] or 0) for r in order]
    goal = targets(sizes, [float(cycle[i % len(cycle)]) for i in range(len(order))], most)
    width = max(shard_words, -(-sum(sizes) // max_shards))
    n_shards = [max(1, -(-s // width)) for s in sizes]
    schema = "source string, source_size bigint, target double, n_shards bigint, k int"
    info = spark.createDataFrame([(r["source"], s, t, n, k) for k, (r, s, t, n) in enumerate(zip(order, sizes, goal, n_shards, strict=True))], schema)
    named = sized.join(info, sized["source"].eqNullSafe(info["source"])).drop(sized["source"]).drop(info["source"])
    over = F.least("copies", "n_shards")  # the shards that copies of a row are dealt over
    share = lambda j: F.floor(F.col("copies") / over).cast("long") + (j < F.col("copies") % over).cast("long")
    deal = F.transform(F.sequence(F.lit(0).cast("long"), over - 1), lambda j: F.struct(F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)) + j, F.col("n_shards")).alias("shard"), share(j).alias("copies")))
    named = named.withColumn("deal", F.explode(deal)).select("doc_id", "size", "source_size", "target", "k", "deal.shard", "deal.copies")
    shards = sorted(named.groupBy("k", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("s")).collect(), key=lambda r: (r["k"], r["shard"]))

    seats = sainte_lague(np.array(goal), int(round(sum(goal) / block)))
    plan = []
    by_source: dict[int, list] = {}
    for r in shards:
        by_source.setdefault(r["k"], []).append(r)
    for k, own in by_source.items():
        words = np.array([int(r["s"] or 0) for r in own])
        quota = sainte_lague(words.astype(float), int(seats[k]))
        for r, s, q in zip(own, words.tolist(), quota.tolist(), strict=True):
            take = min(q * block, int(most * s))
            passes, rest = divmod(take, s) if s else (0, 0)
            blocks = -(-s // block)
            run = min(blocks, int(round(rest / block)))
            if run == blocks and rest < s:
                run -= 1
            start = (seed * 1000003 + k * 8191 + r["shard"] * 131) % blocks if blocks else 0
            a, b = start * block, (start + run) * block
            if passes >= most:
                b = a
            wrap = max(0, b - blocks * block)
            plan.append((k, int(r["shard"]), int(passes), a, min(b, s), wrap))
    plan_df = spark.createDataFrame(plan, "k int, shard bigint, passes bigint, run_from bigint, run_to bigint, wrap_to bigint")
    w = Window.partitionBy("k", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("copies")
    laid = named.withColumn("first", F.sum(words).over(w) - words).join(plan_df, ["k", "shard"])
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("since", F.col("first") + F.col("copy") * F.col("size"))
    cut = lambda a, b: F.struct(F.greatest(F.lit(0), a - F.col("since")).cast("long").alias("from"), F.least(F.col("size"), b - F.col("since")).cast("long").alias("to"))
    spans = F.filter(F.array(cut(F.lit(0), F.col("wrap_to")), cut(F.col("run_from"), F.col("run_to"))), lambda x: x["from"] < x["to"])
    laid = laid.withColumn("spans", spans)
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return laid.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).alias("taken"), "passes", "spans")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole texts, once for each pass, and cut ones where a run of blocks begins or ends.

    A document taken whole keeps its text. Of a cut one the words of each span stay, in order, with
    single spaces. Documents of which nothing is taken go; those without words stay as they are.
    """
    plan = mix(docs, **options).filter("taken > 0").select(F.col("doc_id").alias("m_id"), F.col("size").alias("m_size"), "passes", "spans").dropDuplicates(["m_id", "m_size"])
    rows = docs.select("doc_id", "text", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("size") == F.col("m_size")), "left")
    words = lambda: F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    whole = F.transform(F.expr("if(passes > 0, sequence(1L, passes), array())"), lambda _: F.col("text"))
    parts = F.when(F.size("spans") > 0, F.transform("spans", lambda x: F.when((x["from"] == 0) & (x["to"] == F.col("size")), F.col("text")).otherwise(F.array_join(F.slice(words(), (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), " ")))).otherwise(F.array().cast("array<string>"))
    # without words there is nothing to mix: such a row stays once
    texts = F.when(F.col("size") == 0, F.array(F.col("text"))).when(F.col("m_id").isNull() & F.col("passes").isNull(), F.array().cast("array<string>")).otherwise(F.concat(whole, parts))
    out = joined.select("row", F.explode(texts).alias("new_text"))
    return out.select(*[F.col("new_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
