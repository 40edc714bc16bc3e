"""Queries over intervals, annotations, samples, text and quality statistics, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I
from ..operators import pileup as P
from ..operators import qc as Q
from ..plans import alignment_view as V
from .pileup import W, WT, placed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = "WITH iv AS (SELECT user_id AS tid, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28400000 AS start, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28400000 + CAST(floor(abs(value)) AS BIGINT) AS stop FROM events)"


def spans(spark, sf):
    start = F.floor(F.unix_timestamp("ts") / 60) - 28400000
    return V.table(spark, sf, "events").select(F.col("user_id").alias("tid"), start.alias("start"), (start + F.floor(F.abs("value"))).alias("stop"))


ISLANDS = """, f AS (SELECT *, CASE WHEN start - 1 > max(stop) OVER (PARTITION BY tid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM iv),
  n AS (SELECT *, sum(nw) OVER (PARTITION BY tid ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT tid, min(start) AS start, max(stop) AS stop FROM n GROUP BY tid, k)"""


@query(EV + ISLANDS + " SELECT tid, start, stop FROM m")
def interval_load_merge(spark, sf):
    return I.merge(spans(spark, sf), ["tid"])


@query(EV + ISLANDS + " SELECT tid, count(*) AS n, CAST(sum(stop - start + 1) AS BIGINT) AS covered, min(start) AS first, max(stop) AS last FROM m GROUP BY tid")
def interval_union_size(spark, sf):
    return interval_load_merge(spark, sf).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start") + 1).alias("covered"), F.min("start").alias("first"), F.max("stop").alias("last"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey % 50 AS t, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS s, o_custkey % 30 AS n FROM orders),
  p AS (SELECT *, s + n AS e, lag(s) OVER w AS ps, lag(s + n) OVER w AS pe FROM a WINDOW w AS (PARTITION BY t ORDER BY s, o_orderkey))
  SELECT o_orderkey, coalesce(s <= pe AND ps <= e, false) AS overlapping, coalesce(s - 1 <= pe AND ps - 1 <= e, false) AS touching, CAST(CASE WHEN s - 1 <= pe AND ps - 1 <= e THEN greatest(e, pe) - least(s, ps) ELSE 0 END AS BIGINT) AS union_length FROM p""")
def interval_contiguity(spark, sf):
    from pyspark.sql import Window

    s = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    a = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("t"), s.alias("start"), (s + F.col("o_custkey") % 30).alias("stop"))
    w = Window.partitionBy("t").orderBy("start", "o_orderkey")
    a = a.withColumns({"pa": F.lag("start").over(w), "pb": F.lag("stop").over(w)})
    joined = I.merge_pair(F.col("start"), F.col("stop"), F.col("pa"), F.col("pb"))
    over = (F.col("start") <= F.col("pb")) & (F.col("pa") <= F.col("stop"))
    return a.select("o_orderkey", F.coalesce(over, F.lit(False)).alias("overlapping"), F.coalesce(I.contiguous(F.col("start"), F.col("stop"), F.col("pa"), F.col("pb")), F.lit(False)).alias("touching"), F.coalesce(joined["stop"] - joined["start"], F.lit(0)).cast("long").alias("union_length"))


REGIONS = "rg AS (SELECT p_partkey % 7 AS t, (p_partkey * 37) % 2500 AS a, (p_partkey * 37) % 2500 + p_size % 8 AS b FROM part)"


def regions(spark, sf):
    a = (F.col("p_partkey") * 37) % 2500
    return V.table(spark, sf, "part").select((F.col("p_partkey") % 7).cast("int").alias("tid"), a.alias("a"), (a + F.col("p_size") % 8).alias("b"))


@query(W + f", {REGIONS} SELECT tid, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM reads WHERE EXISTS (SELECT 1 FROM rg WHERE t = tid AND a <= pos + len - 1 AND b >= pos) GROUP BY tid")
def bed_semi_join(spark, sf):
    r = V.reads(spark, sf).withColumn("stop", F.col("pos") + F.col("len") - 1)
    return I.range_join(r, regions(spark, sf), ["tid"], "pos", "stop", "a", "b", "left_semi", 64).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query(W + f", {REGIONS} SELECT tid, count(*) AS n FROM reads WHERE NOT EXISTS (SELECT 1 FROM rg WHERE t = tid AND a <= pos + len - 1 AND b >= pos) GROUP BY tid")
def bed_anti_join(spark, sf):
    r = V.reads(spark, sf).withColumn("stop", F.col("pos") + F.col("len") - 1)
    return I.range_join(r, regions(spark, sf), ["tid"], "pos", "stop", "a", "b", "left_anti", 64).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REGIONS}, v AS (SELECT o_orderkey, o_orderkey % 7 AS t, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS pos FROM orders) SELECT rg.t AS tid, a, b, count(*) AS hits, min(o_orderkey) AS first_id FROM rg JOIN v ON v.t = rg.t AND pos BETWEEN a AND b GROUP BY ALL")
def range_join_cursor(spark, sf):
    pos = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    v = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("tid"), pos.alias("pos"), pos.alias("pos_to"))
    # regions and positions that repeat meet once, with their numbers
    each = regions(spark, sf).groupBy("tid", "a", "b").agg(F.count(F.lit(1)).alias("times"))
    at = v.groupBy("tid", "pos", "pos_to").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))
    hits = I.range_join(each, at, ["tid"], "a", "b", "pos", "pos_to", width=64)
    return hits.groupBy("tid", "a", "b").agg(F.sum(F.col("times") * F.col("n")).alias("hits"), F.min("first_id").alias("first_id"))


@query(W + " SELECT tid, count(*) AS n FROM reads WHERE suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 0) GROUP BY tid")
def read_group_anti(spark, sf):
    out = V.table(spark, sf, "supplier").filter("s_nationkey % 5 = 0").select(F.col("s_suppkey").alias("suppkey"))
    return V.reads(spark, sf).join(out, "suppkey", "left_anti").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@query(W + ", g AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT coalesce(n_name, 'unknown') AS sample, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM reads LEFT JOIN g ON suppkey = s_suppkey GROUP BY 1")
def rg_to_sample(spark, sf):
    g = V.table(spark, sf, "supplier").join(F.broadcast(V.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("suppkey"), F.col("n_name").alias("sample"))
    # the sum per group first: the join then meets one row a group
    per = V.reads(spark, sf).groupBy("suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))
    return per.join(g, "suppkey", "left").groupBy(F.coalesce("sample", F.lit("unknown")).alias("sample")).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"))


MARKS = "mk AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) AS tid, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS p, o_orderpriority LIKE '1%' AS cosmic FROM orders)"


def marks(spark, sf):
    p = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("tid"), p.alias("p"), F.col("o_orderpriority").startswith("1").alias("cosmic"))


@query(W + f", {MARKS}, st AS (SELECT DISTINCT tid, pos AS p FROM reads), d AS (SELECT tid, p, min(o_orderkey) FILTER (WHERE NOT cosmic) AS db, min(o_orderkey) FILTER (WHERE cosmic) AS co FROM mk GROUP BY tid, p) SELECT st.tid, st.p, coalesce(db, -1) AS first_id, CASE WHEN db IS NOT NULL AND co IS NOT NULL THEN 'DBSNP+COSMIC' WHEN db IS NOT NULL THEN 'DBSNP' WHEN co IS NOT NULL THEN 'COSMIC' ELSE 'NOVEL' END AS site FROM st LEFT JOIN d USING (tid, p)")
def annotation_first_match(spark, sf):
    sites = V.reads(spark, sf).select("tid", F.col("pos").alias("p")).distinct()
    m = marks(spark, sf)
    s = I.first_match(sites, m.filter(~F.col("cosmic")), ["tid", "p"], ["o_orderkey"], ["o_orderkey"]).withColumnRenamed("o_orderkey", "first_id")
    s = I.first_match(s, m.filter("cosmic"), ["tid", "p"], ["o_orderkey"], ["o_orderkey"])
    return s.select("tid", "p", F.coalesce("first_id", F.lit(-1).cast("long")).alias("first_id"), X.site_label(F.col("first_id").isNotNull(), F.col("o_orderkey").isNotNull()).alias("site"))


@query(W + ", st AS (SELECT DISTINCT tid, pos FROM reads) SELECT tid, pos, CAST(CASE WHEN tid = 1 AND pos BETWEEN 100 AND 400 THEN 1 WHEN tid = 3 AND pos BETWEEN 900 AND 2000 THEN 0 ELSE 2 END AS INT) AS ploidy FROM st")
def ploidy_lookup(spark, sf):
    table = spark.createDataFrame([(1, 100, 400, 1), (3, 900, 2000, 0), (3, 1500, 1600, 1)], "tid int, a int, b int, ploidy int")
    return I.lookup_with_default(V.reads(spark, sf).select("tid", "pos").distinct(), table, ["tid"], "pos", "a", "b", "ploidy", F.lit(2))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS b FROM events) WHERE value < b")
def sorted_check(spark, sf):
    return I.out_of_order(V.table(spark, sf, "events"), ["event_type", "user_id"], ["ts", "event_id"], "value").select("event_type", "user_id", "event_id")


@query("SELECT tid, CAST(chunk AS BIGINT) AS chunk, CAST(chunk * 400 AS BIGINT) AS start, CAST(least((chunk + 1) * 400, length) - 1 AS BIGINT) AS stop, CAST(greatest(chunk * 400 - 50, 0) AS BIGINT) AS fetch_start, CAST(least(least((chunk + 1) * 400, length) - 1 + 50, length - 1) AS BIGINT) AS fetch_stop FROM (SELECT tid, length, unnest(generate_series(0, (length - 1) // 400)) AS chunk FROM (SELECT CAST(l_linenumber - 1 AS INT) AS tid, max(CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS INT)) + 51 AS length FROM lineitem GROUP BY 1))")
def contig_chunks(spark, sf):
    c = V.reads(spark, sf).groupBy("tid").agg((F.max("pos") + 51).alias("length"))
    out = I.chunks(c, 400, 50)
    return out.select("tid", *[F.col(x).cast("long").alias(x) for x in ("chunk", "start", "stop", "fetch_start", "fetch_stop")])


@query("SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(list_transform(t, lambda x: lower(x)), '|') AS joined FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM documents)")
def tokenize_join(spark, sf):
    t = X.tokenize(F.col("text"), " ")
    return V.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.transform(t, F.lower), "|").alias("joined"))


@query("SELECT o_orderkey, o_orderpriority AS id, CAST(o_custkey AS VARCHAR) AS sample, CAST(3 AS INT) AS n_tags FROM orders")
def header_map(spark, sf):
    line = F.concat_ws("\t", F.lit("@RG"), F.concat(F.lit("ID:"), "o_orderpriority"), F.concat(F.lit("SM:"), F.col("o_custkey").cast("string"), F.lit(":x")), F.lit("skipped"), F.lit("PL:P"))
    t = V.table(spark, sf, "orders").select("o_orderkey", X.header_tags(line).alias("t"))
    return t.select("o_orderkey", F.col("t")["ID"].alias("id"), F.col("t")["SM"].alias("sample"), F.size("t").alias("n_tags"))


@query("SELECT o_orderkey, CAST(o_custkey AS INT) AS pos, 'A' AS ref, CAST(2 AS INT) AS n_alt, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS INT) AS n_info, o_orderstatus AS vc, o_orderkey % 3 = 0 AS flagged FROM orders")
def vcf_parse_fields(spark, sf):
    from ..sources.vcf import parse

    info = F.concat(F.lit("VC="), "o_orderstatus", F.lit(";DP=7"), F.when(F.col("o_orderkey") % 3 == 0, ";ASP").otherwise(""))
    line = F.concat_ws("\t", F.lit("chr1"), (F.col("o_custkey") + 1).cast("string"), F.col("o_orderkey").cast("string"), F.lit("A"), F.lit("C,G"), F.lit("."), F.lit("PASS"), info)
    v = parse(V.table(spark, sf, "orders").select("o_orderkey", line.alias("value")), keep=["o_orderkey"])
    return v.select("o_orderkey", "pos", "ref", F.size("alt").alias("n_alt"), F.size("info").alias("n_info"), F.col("info")["VC"].alias("vc"), F.map_contains_key("info", F.lit("ASP")).alias("flagged"))


@query("SELECT p_partkey, CASE WHEN abs(v) < 5e-4 THEN '0' WHEN abs(round(v, 0) - v) < 5e-4 THEN format('{:.0f}', round(v, 0)) WHEN abs(round(v, 1) - v) < 5e-4 THEN format('{:.1f}', round(v, 1)) WHEN abs(round(v, 2) - v) < 5e-4 THEN format('{:.2f}', round(v, 2)) ELSE format('{:.3f}', v) END AS t FROM (SELECT p_partkey, p_retailprice AS v FROM part)")
def round_format(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", X.round_nearest_text(F.col("p_retailprice"), 3).alias("t"))


@query("SELECT key, CAST(CASE key WHEN 'len' THEN sum(v) WHEN 'min' THEN min(v) WHEN 'max' THEN max(v) ELSE arg_min(v, f) END AS BIGINT) AS value FROM (SELECT f, 'len' AS key, sum(n_chars) AS v FROM d GROUP BY f UNION ALL SELECT f, 'min', min(n_chars) FROM d GROUP BY f UNION ALL SELECT f, 'max', max(n_chars) FROM d GROUP BY f UNION ALL SELECT f, 'first', count(*) FROM d GROUP BY f) GROUP BY key".replace("FROM d", "FROM (SELECT source AS f, n_chars FROM documents) d"))
def qc_merge_sum_min_max(spark, sf):
    d = V.table(spark, sf, "documents").groupBy(F.col("source").alias("file_no")).agg(F.sum("n_chars").alias("len"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.count(F.lit(1)).alias("first"))
    rows = d.unpivot(["file_no"], ["len", "min", "max", "first"], "key", "value")
    return Q.merge_numbers(rows, {"len": "sum", "min": "min", "max": "max"})


@query("WITH c AS (SELECT lang, i, sum(x) AS x FROM (SELECT lang, unnest(generate_series(0, 3)) AS i, unnest([1, n_chars % 5, n_chars % 7, n_chars % 3]) AS x FROM documents) GROUP BY lang, i) SELECT lang, CAST(i AS INT) AS i, CAST(x AS BIGINT) AS x FROM c")
def qc_matrix_add(spark, sf):
    n = F.col("n_chars")
    rows = V.table(spark, sf, "documents").select("lang", F.array(F.lit(1).cast("long"), n % 5, n % 7, n % 3).alias("values"))
    return Q.add_matrices(rows, ["lang"]).select("lang", F.posexplode("values").alias("i", "x"))


@query("WITH h AS (SELECT source, n_chars // 100 AS x, count(*) AS w FROM documents GROUP BY ALL) SELECT source, round(sum(x * w) / sum(w), 6) AS mean, round(sqrt(greatest(sum(w * x * x) / sum(w) - (sum(x * w) / sum(w)) * (sum(x * w) / sum(w)), 0)), 5) AS sd FROM h GROUP BY source")
def qc_weighted_mean_sd(spark, sf):
    h = V.table(spark, sf, "documents").groupBy("source", F.floor(F.col("n_chars") / 100).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    out = h.groupBy("source").agg(*Q.weighted("x", "w"))
    return out.select("source", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"))


@query("""WITH h AS (SELECT source, CAST(n_chars // 100 AS BIGINT) AS x, count(*) AS w FROM documents GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY x) AS run, sum(w) OVER (PARTITION BY source) AS n FROM h)
  SELECT source, CAST(CASE WHEN floor(25 * (max(n) + 1) / 100) <= 0 THEN 0 WHEN floor(25 * (max(n) + 1) / 100) >= max(n) THEN max(x) ELSE min(x) FILTER (WHERE run >= floor(25 * (n + 1) / 100)) END AS BIGINT) AS p25,
  CAST(CASE WHEN floor(50 * (max(n) + 1) / 100) <= 0 THEN 0 WHEN floor(50 * (max(n) + 1) / 100) >= max(n) THEN max(x) ELSE min(x) FILTER (WHERE run >= floor(50 * (n + 1) / 100)) END AS BIGINT) AS p50 FROM r GROUP BY source""")
def hist_percentile(spark, sf):
    h = V.table(spark, sf, "documents").groupBy("source", F.floor(F.col("n_chars") / 100).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    return Q.histogram_percentile(h, ["source"], "x", "w", [25, 50])


GC = """WITH t AS (SELECT replace(text, chr(10), ' ') AS text FROM documents), l AS (SELECT substr(text, CAST(k * 60 + 1 AS INT), 60) AS line FROM (SELECT text, unnest(generate_series(0, (length(text) - 1) // 60)) AS k FROM t WHERE length(text) > 0)), m AS (SELECT max(length(line)) AS longest FROM l),
  c AS (SELECT length(line) - length(regexp_replace(line, '[GCgc]', '', 'g')) AS n, count(*) AS lines FROM l GROUP BY 1), g AS (SELECT n, n * 100 / longest AS gc, lines / max(lines) OVER () AS freq FROM c, m)"""


def fixed_lines(spark, sf):
    """The documents as lines of 60 letters."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    whole = V.table(spark, sf, "documents").select(text.alias("text")).filter("length(text) > 0")
    return whole.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 60).cast("int")), lambda k: F.substring(F.col("text"), k * 60 + 1, F.lit(60)))).alias("line"))


@query(GC + " SELECT round(gc, 6) AS gc, round(freq, 6) AS freq FROM g WHERE n > 0")
def gc_content(spark, sf):
    return Q.gc_of_lines(fixed_lines(spark, sf)).select(F.round("gc", 6).alias("gc"), F.round("freq", 6).alias("freq"))


@query(GC + " SELECT printf('%.6f', gc) || chr(9) || printf('%.6f', freq) AS line FROM g WHERE n > 0")
def gc_statistics(spark, sf):
    from ..sinks.calls import gc_lines

    return gc_lines(Q.gc_of_lines(fixed_lines(spark, sf))).select("line")


@query("WITH h AS (SELECT source, n_chars // 50 AS size, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_min(size, -n * 1000000 + size) AS peak, max(n) AS height FROM h GROUP BY source")
def insert_peak(spark, sf):
    h = V.table(spark, sf, "documents").groupBy("source", F.floor(F.col("n_chars") / 50).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return Q.peak(h, ["source"], "size", "n")


@query("SELECT o_orderpriority, round(coalesce(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0), 0), 6) AS ratio FROM orders GROUP BY 1")
def indel_ratio(spark, sf):
    s = F.col("o_orderstatus")
    g = V.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("i"), F.count_if(s == "P").alias("d"))
    return g.select("o_orderpriority", F.round(Q.indel_ratio(F.col("i"), F.col("d")), 6).alias("ratio"))


@query("SELECT label, CAST(count(*) FILTER (WHERE vec_id % 41 >= 31) AS DOUBLE) AS over30, CAST(count(*) FILTER (WHERE vec_id % 41 BETWEEN 21 AND 31) AS DOUBLE) AS q21_30, CAST(count(*) FILTER (WHERE vec_id % 41 BETWEEN 11 AND 20) AS DOUBLE) AS q11_20, CAST(count(*) FILTER (WHERE vec_id % 41 BETWEEN 1 AND 10) AS DOUBLE) AS to10, CAST(count(*) FILTER (WHERE vec_id % 41 = 0) AS DOUBLE) AS n FROM embeddings GROUP BY label")
def mismatch_bands(spark, sf):
    one = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.when(F.col("vec_id") % 41 == k, 1.0).otherwise(0.0))
    rows = V.table(spark, sf, "embeddings").select("label", one.alias("values"))
    return Q.add_matrices(rows, ["label"]).select("label", Q.quality_bands(F.col("values")).alias("b")).select("label", "b.*")


@query("WITH g AS (SELECT lang, n_chars % 100 AS gc, max(doc_id) AS v FROM documents GROUP BY ALL), r AS (SELECT lang, arg_min(v, abs(gc - 30) * 1000 + gc) AS at30, arg_min(v, abs(gc - 40) * 1000 + gc) AS at40, arg_min(v, abs(gc - 50) * 1000 + gc) AS at50 FROM g GROUP BY lang) SELECT * FROM r")
def gc_depth_ticks(spark, sf):
    g = V.table(spark, sf, "documents").groupBy("lang", (F.col("n_chars") % 100).alias("gc")).agg(F.max("doc_id").alias("v"))
    return Q.nearest_ticks(g, ["lang"], "gc", [30, 40, 50], "v")


CS = WT + """, c AS (SELECT tid, p, max(ref) AS ref, count(*) AS n, count(*) FILTER (WHERE base <> ref) AS k FROM pile GROUP BY tid, p)
  SELECT tid || chr(9) || (p + 1) || chr(9) || ref || chr(9) || CASE WHEN n >= 14 THEN 'COVERED' ELSE 'UNCOVERED' END || chr(9) || (CASE WHEN abs(f) < 5e-4 THEN '0' WHEN abs(round(f, 0) - f) < 5e-4 THEN format('{:.0f}', round(f, 0)) WHEN abs(round(f, 1) - f) < 5e-4 THEN format('{:.1f}', round(f, 1)) WHEN abs(round(f, 2) - f) < 5e-4 THEN format('{:.2f}', round(f, 2)) ELSE format('{:.3f}', f) END) AS line
  FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE k / n END AS f FROM c)"""


@query(CS)
def call_stats_format(spark, sf):
    # depth from the ends of reads; only bases that differ become rows
    r = placed(spark, sf).filter(F.col("mapq") > 0)
    n = P.depth_by_boundaries(r.select("tid", F.col("pos").alias("start"), (F.col("pos") + F.col("len") - 1).alias("stop"))).withColumnRenamed("depth", "n")
    k = V.mismatches(r).groupBy("tid", "p").agg(F.count(F.lit(1)).alias("k"))
    t = n.join(k, ["tid", "p"], "left").withColumn("ref", V.ref_base(F.col("tid"), F.col("p")))
    f = F.coalesce(F.try_divide("k", "n"), F.lit(0.0))
    return t.select(F.concat_ws("\t", F.col("tid").cast("string"), (F.col("p") + 1).cast("string"), "ref", X.covered_label(F.col("n") >= 14), X.round_nearest_text(f, 3)).alias("line"))
