"""Line-level deduplication by content-defined chunks of lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, done_with, filter_bits, has_bit, let, materialize, may_be_in, place

MOST = 15  # lines of a chunk: its code is at * 16 + lines


def chunks(text: Column, least: int = 2, words: int = 50, mask: int = 1, most: int = 8, bodies: bool = False) -> Column:
    """Content-defined chunks of a text's lines as structs (at, lines, h), with their text if ``bodies``.

    A rolling hash over the hashes of ``least`` lines is taken at each line; where its bits under
    ``mask`` are zero there is a boundary. From each line a chunk runs down to the next boundary
    behind it, and up to the next one before it; a boundary counts once the chunk holds the lines it
    is hashed from, so no chunk is shorter than ``least`` lines. Holding ``words`` words or ``most``
    lines closes a chunk too, and a line of ``words`` words is a chunk by itself. What a chunk
    holds thus depends on its own lines alone, whatever stands around it: of a passage of at least
    ``words`` words, the chunks down from its first line and up from its last lie inside it.
    Lines end at \\n; a line holds one word more than it has blanks.
    """
    assert least <= most <= MOST

    def of_lines(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hs: of_hashes(lines, hs))

    def of_hashes(lines: Column, hs: Column) -> Column:
        n = F.size(lines)
        bounds = lambda at: F.coalesce((at >= 0) & (at + least <= n) & (F.xxhash64(F.slice(hs, F.greatest(at, F.lit(0)) + 1, least)).bitwiseAND(F.lit(mask)) == 0), F.lit(False))
        # down: the boundary after a line is hashed from the lines that end there; up: the one before it from those that begin there
        marks = F.transform(lines, lambda x, i: F.struct((F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w"), bounds(i - least + 1).alias("down"), bounds(i).alias("up")))
        return let(marks, lambda m: of_marks(lines, hs, m, n))

    def closed(part: Column, stop: str) -> Column:
        """Lines of the chunk that begins a run of marks; 0 if nothing closes it."""
        start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"), F.lit(0).alias("k"))

        def step(a: Column, x: Column) -> Column:
            k, w = a["k"] + 1, a["words"] + x["w"]
            over = ((k >= least) & (x[stop] | (w >= words) | (k == most))) | (w >= words)
            return F.when(a["lines"] > 0, a).otherwise(F.struct(F.when(over, k).otherwise(0).alias("lines"), w.alias("words"), k.alias("k")))

        return F.aggregate(part, start, step)["lines"]

    def of_marks(lines: Column, hs: Column, m: Column, n: Column) -> Column:
        every = F.sequence(F.lit(0), n - 1)
        down = F.transform(every, lambda i: let(closed(F.slice(m, i + 1, most), "down"), lambda k: F.when(k > 0, i.cast("long") * 16 + k)))
        back = lambda i: F.reverse(F.slice(m, F.greatest(i + 2 - most, F.lit(1)), F.least(i + 1, F.lit(most))))
        up = F.transform(every, lambda i: let(closed(back(i), "up"), lambda k: F.when(k > 0, (i + 1 - k).cast("long") * 16 + k)))
        codes = F.array_distinct(F.array_compact(F.concat(down, up)))

        def one(c: Column) -> Column:
            at, k = F.shiftright(c, 4).cast("int"), c.bitwiseAND(F.lit(15)).cast("int")
            own = [at.alias("at"), k.alias("lines"), F.xxhash64(F.slice(hs, at + 1, k)).alias("h")]
            return F.struct(*own, F.array_join(F.slice(lines, at + 1, k), "\n").alias("body")) if bodies else F.struct(*own)

        return F.transform(codes, one)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), of_lines)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by doc_id and text: rows that share a doc_id stay apart, whatever order they are read in."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def repeated_chunks(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, th, at, lines): every chunk that stands earlier too.

    Earliest is the smallest (doc_id, hash of the text, at), null ids last. Chunk hashes are counted
    over all documents first; only chunks whose hash may repeat (behind a bit filter) are gathered
    with their text and grouped by it, which compares bytes; each meets the first of its group again
    by the SHA-256 of that text.
    """
    keyed = _keyed(docs)
    hits = keyed.select(F.explode(chunks(F.col("text"), **options)).alias("c")).groupBy("c.h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    hits = materialize(hits, "chunk-hits")
    bits = filter_bits(hits.count())
    cut = keyed.select("doc_id", "th", F.explode(chunks(F.col("text"), bodies=True, **options)).alias("c")).select("doc_id", "th", "c.at", "c.lines", "c.h", "c.body")
    maybe = materialize(may_be_in(cut, F.col("h"), bit_filter(hits, F.col("h"), bits), bits), "chunks")
    place_ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha")
    first = maybe.groupBy("h", "body").agg(F.min(place_).alias("first"), F.max(place_).alias("last")).filter("first != last")
    first = materialize(first.select("h", sha, "first"), "firsts")
    same = maybe.select("doc_id", "th", "at", "lines", "h", sha)
    gone = materialize(same.join(first, ["h", "sha"]).filter(place_ != F.col("first")).select("doc_id", "th", "at", "lines"), "repeated")
    done_with(hits, maybe, first)
    return gone


def dedup_lines(docs: DataFrame, least: int = 2, words: int = 50, **options) -> DataFrame:
    """(doc_id, text, n_lines, removed): texts without the chunks of lines that stand earlier in the corpus.

    Chunks are content-defined (:func:`chunks`). Of a passage of at least ``words`` words that
    repeats whole lines, every later copy goes; of shorter ones, those that hold a whole chunk. The
    copy in the smallest doc_id stays (of one document, the first). Each line that goes stands in an
    earlier place, so no line is lost. Lines that repeat alone and hold under ``words`` words stay,
    as do all texts without repeats, a null text as null.

    Rows are cut one by one: those that share a doc_id are documents of their own, a null doc_id
    comes last; rows equal in doc_id and text are copies of one row and get the same text. An empty
    table gives no rows. Other columns are not read.
    """
    gone = repeated_chunks(docs, least=least, words=words, **options)
    lines = F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("lines") - 1)))
    per = materialize(gone.groupBy("doc_id", "th").agg(F.array_distinct(lines).alias("cut")), "cuts")
    bits = filter_bits(per.count())
    key = F.struct("doc_id", "th")
    placed = place(_keyed(docs), key, bits)
    placed = placed.join(F.broadcast(bit_filter(per, key, bits)), "f_block", "left").withColumn("f_hit", has_bit(F.col("f_map"), F.col("f_bit")))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    clear = placed.filter(~F.col("f_hit")).select("doc_id", "text", n_lines.alias("n_lines"), F.lit(0).alias("removed"))
    own = per.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "cut")
    hit = placed.filter("f_hit").join(own, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left").withColumn("n_lines", n_lines)
    left = let(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("cut")), lambda i: F.get(x, i)), "\n"))
    done = hit.select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("text"), "n_lines", F.coalesce(F.size("cut"), F.lit(0)).alias("removed"))
    return clear.unionByName(done)
