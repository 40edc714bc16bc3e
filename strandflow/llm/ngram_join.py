"""Exact Jaccard self-join of word-shingle sets in their metric space: pivots, Voronoi regions, triangle windows, recursion.

1 - Jaccard is a metric. Documents that can have no partner leave first. Of the others some are
elected pivots; each document lies in the region of its nearest pivot, if that is near enough, and
is replicated to the regions of other pivots where the triangle inequality lets it have a partner.
Documents far from all pivots go on with new pivots among themselves until none is left. Inside a
region a document is its difference from the pivot: what links to the pivot is one class, and pairs
of different classes are found by an exact prefix filter over differences, never over all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, done_with, filter_bits, materialize, may_be_in, without
from .components import connected_components
from .tokens import buffers, lists, shingle_sets, slices


def _needed(n, percent: int):
    """Least intersection of a pair at ``percent`` in which one set has n members."""
    return (n * percent + 99) // 100


def _sketches(words: int, percent: int, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in slices(off):
                sets = shingle_sets(data, off[lo : hi + 1], words)
                prefix = [s[: len(s) - _needed(len(s), percent) + 1 + len(s) // extra] if len(s) else s for s in sets]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *_digests(sets), lists(prefix)], ["doc_id", "n", "d1", "d2", "prefix"])

    return run


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """n, d1, d2: size and two sums by which equal sets meet."""
    d1 = [int(s.sum()) if len(s) else 0 for s in sets]
    d2 = [int(((s ^ (s >> 31)) * 0x5851F42D4C957F2D).sum()) if len(s) else 0 for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in slices(off):
                sets = shingle_sets(data, off[lo : hi + 1], words)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *_digests(sets), lists(sets)], ["rep", "n", "d1", "d2", "members"])

    return run


def _col_needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _at_least(percent: int) -> Column:
    """Jaccard of a row (n, nq, i) against a threshold, in whole numbers."""
    return F.col("i") * 100 >= (F.col("n") + F.col("nq") - F.col("i")) * percent


def _may_link(sketch: DataFrame, reps: DataFrame, percent: int, extra: int) -> DataFrame:
    """Class representatives (rows of ``reps``) that share enough of their first shingles, in hash order, with any others.

    Of two linked sets, with o the least overlap of a link, the first n - o + l shingles of either
    have l in common; the others leave without a comparison. Copies of a representative take no
    part; where a doc_id has several texts, all its classes stay.
    """
    copies = materialize(sketch.select("doc_id").distinct().join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "copies")
    first = without(sketch.select("doc_id", "prefix"), copies).select("doc_id", F.explode("prefix").alias("token"))
    held = first.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    hits = first.join(held, "token", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.count(F.lit(1)).alias("hits"))
    least = 1 + F.floor(_col_needed(F.col("n"), percent) / extra)  # what a link to the smallest fitting partner shares
    live = materialize(reps.join(hits, "rep").filter(F.col("hits") >= least).drop("hits"), "live")
    done_with(copies)
    return live


def _core(active: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, score, members): sets of which other active sets hold enough shingles for a link.

    members are the shingles that others hold, rarest first; score is their company on average. A
    shingle that one set alone holds is in no intersection, so sizes say all there is to know of it.
    """
    rows = active.select("doc_id", "n", F.explode("members").alias("token"))
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    kept = rows.join(df, "token").groupBy("doc_id", "n").agg(F.avg("df").alias("score"), F.collect_list(F.struct("df", "token")).alias("shared"))
    # rows that repeat a set count once
    kept = kept.select("doc_id", "n", (F.col("score") * F.size("shared") / F.col("n")).alias("score"), F.array_distinct(F.transform(F.sort_array("shared"), lambda x: x["token"])).alias("members"))
    return kept.filter(F.size("members") >= _col_needed(F.col("n"), percent))


def _heads(core: DataFrame, near: int) -> DataFrame:
    """(doc_id, n, token): the rarest shared shingles; sets of at least ``near`` per cent similarity have one in common."""
    room = (F.size("members") - _col_needed(F.col("n"), near) + 1).cast("int")
    return core.select("doc_id", "n", F.explode(F.slice("members", F.lit(1), F.greatest(room, F.lit(0)))).alias("token"))


def _elected(core: DataFrame) -> DataFrame:
    """(doc_id): the pivots. Every document votes for the one that has most company among the holders of its shingles.

    A shingle is led by its holder of the highest score, so the middle of a group leads the group; a
    document votes for the leader of most of its shingles, of which an eighth, by their hash, and the
    least are asked.
    """
    asked = F.array_distinct(F.concat(F.filter("members", lambda x: F.pmod(x, F.lit(8)) == 0), F.array(F.array_min("members"))))
    rows = core.select("doc_id", "score", F.explode(asked).alias("token"))
    leaders = rows.groupBy("token").agg(F.max(F.struct("score", F.col("doc_id").alias("q")))["q"].alias("q"))
    votes = rows.join(leaders, "token").groupBy("doc_id", "q").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("doc_id").agg(F.max_by("q", F.struct("c", "q")).alias("q")).select(F.col("q").alias("doc_id")).distinct()


def _chosen(core: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``ids``; others are not shuffled."""
    bits = filter_bits(ids.count())
    return may_be_in(core, F.col("doc_id"), bit_filter(ids, F.col("doc_id"), bits), bits).join(ids, "doc_id", "left_semi")


def _whole(pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pivots with their whole sets: what a pivot alone holds, all differ from it by, and so have in common."""
    full = _chosen(sets, pivots.select("doc_id")).dropDuplicates(["doc_id"])
    return pivots.join(full.select("doc_id", F.array_distinct("members").alias("whole")), "doc_id")


def _near(core: DataFrame, pivots: DataFrame, near: int) -> DataFrame:
    """(doc_id, q, n, nq, i, diff): every pivot of at least ``near`` per cent similarity, with the shingles that differ.

    diff has all of the pivot's that the document lacks, and the document's that others hold too.
    """
    own = _heads(pivots, near).select("token", F.col("doc_id").alias("q"), F.col("n").alias("nq"))
    pairs = _heads(core, near).join(own, "token").filter(_sizes_fit("n", "nq", near)).select("doc_id", "q").distinct()
    both = pairs.join(pivots.select(F.col("doc_id").alias("q"), F.col("n").alias("nq"), F.col("whole").alias("p")), "q").join(core.select("doc_id", "n", F.col("members").alias("x")), "doc_id")
    out = both.withColumn("only", F.array_except("x", "p")).withColumn("i", (F.size("x") - F.size("only")).cast("long"))
    return out.filter(_at_least(near)).select("doc_id", "q", "n", "nq", "i", F.concat("only", F.array_except("p", "x")).alias("diff"))


def _homes(near: DataFrame, home: int) -> DataFrame:
    """(doc_id, h, j): the nearest pivot of each document that has one of at least ``home`` per cent similarity j."""
    best = near.filter(_at_least(home)).groupBy("doc_id").agg(F.max(F.struct(_similarity().alias("j"), F.col("q").alias("q"))).alias("best"))
    return best.select("doc_id", F.col("best.q").alias("h"), F.col("best.j").alias("j"))


def _similarity() -> Column:
    return F.col("i") / (F.col("n") + F.col("nq") - F.col("i"))


def _regions(near: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, q, home, n, d, diff): each document at home with its nearest pivot and in the windows of others; d: by how many shingles it differs.

    With r = 100 - percent, pivots are known down to the similarity of a home less r. Let x be at
    home with p and y a partner, d(x, y) <= r. Then d(y, p) <= d(x, p) + r: y knows p, and lies within
    r of the radius of p's region, which is the largest d(x, p) in it. If y has a home h,
    d(x, p) <= d(x, h) gives d(y, p) <= d(y, h) + 2 r. What is linked to p itself is linked by that;
    a region in which nothing else is at home needs no more.
    """
    r = (100 - percent) / 100
    radius = homes.filter("doc_id != h").groupBy(F.col("h").alias("q")).agg(F.min("j").alias("edge"))
    seen = near.join(homes.withColumnRenamed("j", "hj"), "doc_id", "left").join(radius, "q")
    own = F.coalesce(F.col("h") == F.col("q"), F.lit(False))
    window = (_similarity() >= F.col("edge") - r - 1e-9) & (F.col("h").isNull() | (_similarity() >= F.col("hj") - 2 * r - 1e-9))
    return seen.filter(own | window).select("doc_id", "q", own.alias("home"), "n", (F.col("n") + F.col("nq") - 2 * F.col("i")).alias("d"), "diff")


def _open_differences(regions: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(q, doc_id, n, d, s, home, component, heads) of documents that may link to another class of their region.

    For x, y with differences X, Y from the pivot, |x ^ y| = |X| + |Y| - 2 |X & Y|, and a link needs
    |x ^ y| <= r (|x| + |y|), r = (100 - percent) / (100 + percent). As |x ^ y| >= |X| - |Y|, a
    partner shares at least |X| - n (100 - percent) / percent members of X, and at least one: if both
    linked to the pivot they would be of one class. heads are the rarest shared members of X, one
    of which is a partner's head too.
    """
    if labels is None:
        named = regions.withColumn("component", F.col("doc_id"))
    else:
        named = regions.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = lambda df, *k: df.groupBy(*k).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("home").alias("at"), F.count(F.lit(1)).alias("df")).filter("lo != hi and at").select(*k, "df")
    least = F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (100 - percent) / percent))
    named = named.filter(F.size("diff") >= least)  # the others differ too much in shingles of their own
    named = named.join(several(named, "q").select("q"), "q", "left_semi")
    rows = named.select("q", "doc_id", "n", "d", "home", "component", F.explode("diff").alias("token"))
    kept = rows.join(several(rows, "q", "token"), ["q", "token"])
    per = kept.groupBy("q", "doc_id", "n", "d", "home", "component").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    room = (F.size("shared") - least + 1).cast("int")
    return per.filter(room > 0).select("q", "doc_id", "n", "d", F.size("shared").alias("s"), "home", "component", F.transform(F.slice(F.sort_array("shared"), F.lit(1), room), lambda x: x["token"]).alias("heads"))


def _verified(pairs: DataFrame, regions: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs (q, a, b) that link, worked out from their differences from q."""
    side = lambda k: regions.select("q", F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("d").alias(f"d{k}"), F.col("diff").alias(f"x{k}"))
    both = pairs.join(side("a"), ["q", "a"]).join(side("b"), ["q", "b"])
    apart = F.col("da") + F.col("db") - 2 * F.size(F.array_intersect("xa", "xb"))
    return both.filter(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b").distinct()


def _led_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """(q, a, b): each open document with one of another class, the leader of most of its heads."""
    rows = open_.select("q", "doc_id", "n", "component", F.explode("heads").alias("token"))
    order = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("s"), F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    leaders = rows.groupBy("q", "token").agg(F.array(F.max(order), F.min(order)).alias("leads"))
    asked = rows.join(leaders, ["q", "token"]).select("q", "doc_id", "component", F.explode("leads").alias("lead")).filter(F.col("lead.cb") != F.col("component"))
    votes = asked.groupBy("q", "doc_id", "lead.b").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("q", "doc_id").agg(F.max_by("b", F.struct("c", "b")).alias("b")).select("q", F.col("doc_id").alias("a"), "b")


def _other_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(q, a, b): every pair of different classes of a region that may link, one of them at home there."""
    lo, hi = 100 - percent, 100 + percent
    rows = open_.select("q", "doc_id", "n", "d", "s", "home", "component", F.explode("heads").alias("token"))
    other = rows.select("q", "token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("s").alias("sb"), F.col("home").alias("hb"), F.col("component").alias("cb"))
    may = (F.col("d") + F.col("db") - 2 * F.least("s", "sb")) * hi <= (F.col("n") + F.col("nb")) * lo
    return rows.join(other, ["q", "token"]).filter((F.col("component") < F.col("cb")) & (F.col("home") | F.col("hb")) & _sizes_fit("n", "nb", percent) & may).select("q", F.col("doc_id").alias("a"), "b").distinct()


def _links(sets: DataFrame, percent: int, home: int) -> DataFrame | None:
    """(node, component) of sets (doc_id, n, members) that link to another; None without links."""
    active, found, regions, level = sets, None, None, 0
    while True:
        core = materialize(_core(active, percent), "core")
        if core.isEmpty():
            break
        # what is far from all pivots is thin: its regions are as wide as pivots can still be found
        wide = home if level == 0 else min(home, 100 - percent + 5)
        pivots = materialize(_whole(_chosen(core, materialize(_elected(core), "elected")), sets), "pivots")
        close = materialize(_near(core, pivots, wide - (100 - percent)), "near")
        homes = materialize(_homes(close, wide), "homes")
        here = materialize(_regions(close, homes, percent), "regions")
        star = materialize(close.filter(_at_least(percent) & (F.col("doc_id") != F.col("q"))).select(F.col("doc_id").alias("a"), F.col("q").alias("b")), "stars")
        found = star if found is None else found.unionByName(star)
        regions = here if regions is None else regions.unionByName(here)
        far = materialize(core.select("doc_id").join(homes.select("doc_id"), "doc_id", "left_anti"), "far")
        left = materialize(_chosen(core, far), "left")
        done_with(core, pivots, close, homes, far, active if level else None)
        active, level = left, level + 1
    if found is None or found.isEmpty() and regions.isEmpty():
        return None

    labels = None if found.isEmpty() else connected_components(found)
    open_ = materialize(_open_differences(regions, labels, percent), "open")
    turn = 0
    while True:
        now = open_ if labels is None else _renamed(open_, labels)
        asked = materialize(_led_pairs(now, turn), "asked")
        new = materialize(_verified(asked, regions, percent), "led")
        n, hits = asked.count(), new.count()
        done_with(asked)
        if hits:
            found = found.unionByName(new)
            labels = connected_components(found)
        # classes that many links join are one by now; the few links left are looked for one by one
        if hits * 20 <= n:
            break
        turn += 1
    now = open_ if labels is None else _renamed(open_, labels)
    last = materialize(_verified(_other_pairs(now, percent), regions, percent), "links")
    done_with(open_)
    if not last.isEmpty():
        labels = connected_components(found.unionByName(last))
    return labels


def _renamed(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """Open documents under the classes found since, where several of these are left in a region."""
    now = open_.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = now.groupBy("q").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("q")
    return now.join(mixed, "q", "left_semi")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, home: int = 50, extra: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked when 100 * |A & B| >= percent * |A | B|.

    Words are what lies between ASCII white space, A-Z lower-cased; a set holds the distinct
    ``words``-word shingles of the whole text (a shorter text is one shingle; an empty or null one
    has none and links with nothing). component_id is the smallest doc_id reachable by links. Equal
    sets are one class and are joined once. ``home``: similarity in per cent that a document has to
    its region's pivot at least; it bears on cost alone. Shingles are compared as 64-bit hashes. Rows that repeat a
    doc_id are each placed by their own text; a null doc_id gets a null component. An empty
    table gives no rows. Other columns are not read.
    """
    slim = docs.select("doc_id", "text")
    key = dict(docs.dtypes)["doc_id"]
    sketch = materialize(slim.mapInArrow(_sketches(words, percent, extra), f"doc_id {key}, n bigint, d1 bigint, d2 bigint, prefix array<bigint>"), "sketch")
    has = sketch.filter("n > 0 and doc_id is not null")
    reps = has.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    # a node for each class; the seed is one under which no two classes share their name
    for seed in count():
        node = F.xxhash64("n", "d1", "d2", F.lit(seed))
        classes = materialize(reps.withColumn("node", node), "classes")
        if classes.groupBy("node").count().filter("count > 1").isEmpty():
            break
    reps = classes
    live = _may_link(has, reps, percent, extra)
    names = materialize(sketch.select("doc_id", "n", "d1", "d2"), "names")
    done_with(sketch)

    # a few texts more than those of live classes may pass: they link with nothing that they shouldn't
    bits = filter_bits(live.count(), 64, 1 << 30)
    texts = may_be_in(slim.filter(F.col("doc_id").isNotNull()), F.col("doc_id"), bit_filter(live, F.col("rep"), bits), bits)
    sets = texts.mapInArrow(_sets(words), f"rep {key}, n bigint, d1 bigint, d2 bigint, members array<bigint>").filter("n > 0")
    sets = materialize(sets.select(node.alias("doc_id"), "n", "members"), "sets")
    labels = _links(sets, percent, home)

    named = reps.select("n", "d1", "d2", "rep", "node")
    if labels is not None:
        joined = labels.join(reps.select("node", "rep"), "node")
        least = joined.groupBy("component").agg(F.min("rep").alias("first"))
        named = named.join(joined.join(least, "component").select("node", "first"), "node", "left")
    else:
        named = named.withColumn("first", F.col("rep"))
    named = materialize(named.select("n", "d1", "d2", F.coalesce("first", "rep").alias("component")), "named")
    done_with(sets, live, reps)
    out = names.join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents of which one stays for each component (the smallest doc_id), all their columns.

    Texts without words, and rows without doc_id, stay; of rows that repeat a doc_id all stay where
    one of them has to. Only dropped identifiers are matched, behind
    a bit filter, so kept texts are not shuffled.
    """
    found = jaccard_components(docs, words, percent)
    gone = materialize(found.filter("doc_id is not null").groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select("doc_id"), "gone")
    return without(docs.select("doc_id", F.struct("*").alias("row")), gone).select("row.*")
