"""Queries over text records (alignments, headers, intervals, sequences, statistics) built from the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions import reads as R
from ..functions import text as X
from ..functions.lcg import JavaRandom
from ..operators import alleles as A
from ..operators import bias, indel
from ..operators import intervals as I
from ..operators import pileup as P
from ..operators import qc as Q
from ..plans import alignment_view as V
from ..plans import records as plan
from ..sinks import calls as sinks
from ..sources import regions, sam
from .pileup import W, placed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(df, *fields):
    """One text column ``value`` of tab-separated fields."""
    return df.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))


def alignments(spark, sf):
    """The reads of the alignment view as text records: bases repeat ACGT from a place given by the part, N every 29th read's first base."""
    r = V.reads(spark, sf)
    c = F.col
    n = ((c("partkey") % 4) + c("len") + (c("partkey") % 3)).cast("int")
    seq = F.substring(F.lit("ACGT" * 20), (c("suppkey") % 4 + 1).cast("int"), n)
    seq = F.when(c("partkey") % 29 == 0, F.concat(F.lit("N"), F.substring(seq, F.lit(2), n))).otherwise(seq)
    unmapped = c("mapq") == 0
    return lines(
        r, c("qid"), c("flag"), F.when(unmapped, "*").otherwise(F.concat(F.lit("c"), c("tid").cast("string"))), F.when(unmapped, 0).otherwise(c("pos") + 1), c("mapq"), F.when(unmapped, "*").otherwise(c("cigar")),
        F.when(c("partkey") % 7 == 0, "*").otherwise("="), c("mate_pos") + 1, c("isize"), F.when(unmapped, "*").otherwise(seq), F.when(unmapped, "*").otherwise(F.expr("repeat(char(33 + quality), int(partkey % 4 + len + partkey % 3))")), F.concat(F.lit("RG:Z:"), c("suppkey").cast("string")),
    )


ALN = W + """, z AS (SELECT *, partkey % 4 AS s, len // 2 AS half, 1 + suppkey % 3 AS gap, partkey % 3 AS ins,
  CASE WHEN partkey % 29 = 0 THEN 'N' || substr(substr(repeat('ACGT', 20), CAST(suppkey % 4 + 1 AS INT), CAST(partkey % 4 + len + partkey % 3 AS INT)), 2) ELSE substr(repeat('ACGT', 20), CAST(suppkey % 4 + 1 AS INT), CAST(partkey % 4 + len + partkey % 3 AS INT)) END AS seq FROM reads)"""


@query(ALN + """ SELECT CASE WHEN mapq = 0 THEN '*' ELSE 'c' || tid END AS contig, count(*) AS n, CAST(sum(CASE WHEN mapq = 0 THEN -1 ELSE pos END) AS BIGINT) AS pos_sum, CAST(sum(CASE WHEN mapq = 0 THEN -2 ELSE pos + len + gap - 1 END) AS BIGINT) AS stop_sum, CAST(sum(mapq) AS BIGINT) AS mapq_sum,
  CAST(sum(CASE WHEN mapq = 0 THEN 0 ELSE length(seq) END) AS BIGINT) AS bases, CAST(sum(CASE WHEN mapq = 0 THEN 0 ELSE quality * length(seq) END) AS BIGINT) AS quality_sum, count(DISTINCT suppkey) AS groups, count(*) FILTER (WHERE partkey % 7 <> 0 AND mapq > 0) AS same_contig, CAST(sum(mate_pos) AS BIGINT) AS mates FROM z GROUP BY 1""")
def sam_scan(spark, sf):
    r = sam.records(alignments(spark, sf))
    quality = F.aggregate("qual", F.lit(0).cast("long"), lambda a, x: a + x)
    return r.groupBy(F.coalesce("contig", F.lit("*")).alias("contig")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.sum("stop").alias("stop_sum"), F.sum("mapq").alias("mapq_sum"), F.sum(F.length("seq")).alias("bases"), F.sum(quality).alias("quality_sum"),
        F.count_distinct(F.col("tags")["RG"]).alias("groups"), F.count_if(F.col("mate_contig") == F.col("contig")).alias("same_contig"), F.sum("mate_pos").alias("mates"),
    )


@query(ALN + """, b AS (SELECT tid, mapq, quality, rev, pos + k AS p, s + k AS off, false AS del, seq FROM (SELECT *, unnest(generate_series(0, half - 1)) AS k FROM z WHERE mapq > 0 AND flag & 1796 = 0)
    UNION ALL SELECT tid, mapq, quality, rev, pos + half + k, s + half - 1, true, seq FROM (SELECT *, unnest(generate_series(0, gap - 1)) AS k FROM z WHERE mapq > 0 AND flag & 1796 = 0)
    UNION ALL SELECT tid, mapq, quality, rev, pos + half + gap + k, s + half + ins + k, false, seq FROM (SELECT *, unnest(generate_series(0, len - half - 1)) AS k FROM z WHERE mapq > 0 AND flag & 1796 = 0)),
  c AS (SELECT *, substr(seq, CAST(off + 1 AS INT), 1) AS base FROM b)
  SELECT 'c' || tid AS contig, CAST(p AS INT) AS p, count(*) FILTER (WHERE NOT del AND base = 'A') AS n_a, count(*) FILTER (WHERE NOT del AND base = 'C') AS n_c, count(*) FILTER (WHERE NOT del AND base = 'G') AS n_g, count(*) FILTER (WHERE NOT del AND base = 'T') AS n_t, count(*) FILTER (WHERE del) AS n_del,
    count(*) FILTER (WHERE mapq = 0) AS n_mq0, max(mapq) AS max_mapq, CAST(sum(CASE WHEN del THEN 0 ELSE quality END) AS BIGINT) AS q_sum, CAST(sum(off) AS BIGINT) AS offsets FROM c GROUP BY 1, 2""")
def sam_pile_counts(spark, sf):
    r = sam.records(alignments(spark, sf)).filter(R.placed_read(F.col("flag"), F.col("pos")) & F.col("contig").isNotNull())
    pile = P.unnest(r, ["contig", "mapq"], seq="seq", qual="qual")
    return pile.groupBy("contig", "p").agg(*P.base_counts(F.col("is_del")), F.sum(F.when(F.col("is_del"), 0).otherwise(F.col("quality"))).alias("q_sum"), F.sum("offset").cast("long").alias("offsets"))


HEAD = "h AS (SELECT *, 's' || s_nationkey AS sample, CASE WHEN s_suppkey % 3 = 0 THEN 'ILLUMINA' ELSE 'OTHER' END AS pl FROM supplier)"


def head_lines(spark, sf):
    s, n = V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    pl = F.when(F.col("s_suppkey") % 3 == 0, "ILLUMINA").otherwise("OTHER")
    groups = s.select(F.col("s_suppkey").alias("k"), F.concat_ws("\t", F.lit("@RG"), F.concat(F.lit("ID:"), "s_suppkey"), F.concat(F.lit("SM:s"), "s_nationkey"), F.concat(F.lit("PL:"), pl)).alias("value"))
    contigs = n.select(F.col("n_nationkey").cast("long").alias("k"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "n_name"), F.concat(F.lit("LN:"), (F.col("n_nationkey") * 100 + 7).cast("string"))).alias("value"))
    return contigs.coalesce(1).sortWithinPartitions("k").select("value").unionByName(groups.select("value"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS tid, n_name AS contig, CAST(n_nationkey * 100 + 7 AS BIGINT) AS length FROM nation")
def header_contigs(spark, sf):
    return sam.contigs(sam.header_of(head_lines(spark, sf)))


@query(f"WITH {HEAD} SELECT CAST(s_suppkey AS VARCHAR) AS rg FROM h WHERE pl = 'ILLUMINA'")
def header_platform_groups(spark, sf):
    return sam.platform_groups(sam.header_of(head_lines(spark, sf)), "ILLUMINA,454")


@query(ALN + f", {HEAD} SELECT h.sample, count(*) AS n FROM z JOIN h ON suppkey = s_suppkey GROUP BY 1")
def header_read_samples(spark, sf):
    groups = sam.read_groups(sam.header_of(head_lines(spark, sf)), "f")
    r = sam.records(alignments(spark, sf)).select(F.lit("f").alias("file"), F.col("tags")["RG"].alias("rg"))
    known = r.join(groups.select("file", "rg"), ["file", "rg"], "left_semi")
    return sam.with_sample(known, groups).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT p_partkey, 'c' || (p_partkey % 9) AS contig, p_partkey % 1500 + 1 AS a, p_partkey % 1500 + p_size AS b, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_partkey % 11 <> 0)
  SELECT contig, CAST(a - 3 AS BIGINT) AS start, CAST(b + 1 AS BIGINT) AS stop, strand, 'n' || p_partkey AS name FROM r WHERE CAST(substr(contig, 2) AS INT) < 7 AND b >= a AND b <= 1000 + 100 * CAST(substr(contig, 2) AS INT)""")
def interval_list_scan(spark, sf):
    c = F.col
    p = V.table(spark, sf, "part")
    a = c("p_partkey") % 1500 + 1
    fields = [F.concat(F.lit("c"), c("p_partkey") % 9), a, a - 1 + c("p_size"), F.when(c("p_partkey") % 2 == 0, "+").otherwise("-"), F.concat(F.lit("n"), c("p_partkey"))]
    text = p.select(F.when(c("p_partkey") % 11 == 0, "broken\tline").otherwise(F.concat_ws("\t", *[f.cast("string") for f in fields])).alias("value"))
    head = spark.range(7).select(F.concat(F.lit("@SQ\tSN:c"), c("id"), F.lit("\tLN:"), c("id") * 100 + 1000).alias("value"))
    return regions.intervals_of(head.unionByName(text), padding=2)


@query("SELECT 'c' || (p_partkey % 5) AS contig, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 1 ELSE p_partkey END AS BIGINT) AS beg, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + p_size END AS BIGINT) AS \"end\" FROM part WHERE p_partkey % 10 <> 0")
def bed_scan(spark, sf):
    c = F.col
    two = F.concat_ws("\t", F.concat(F.lit("c"), c("p_partkey") % 5), c("p_partkey").cast("string"), (c("p_partkey") + c("p_size")).cast("string"))
    one = F.concat_ws(" ", F.concat(F.lit("c"), c("p_partkey") % 5), c("p_partkey").cast("string"))
    return regions.bed_of(V.table(spark, sf, "part").select(F.when(c("p_partkey") % 10 == 0, F.concat(F.lit("track "), c("p_name"))).when(c("p_partkey") % 3 == 0, one).otherwise(two).alias("value")))


@query("SELECT 'c' || (p_partkey % 5) AS contig, CAST(p_partkey - 1 AS BIGINT) AS beg, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + p_size END - 1 AS BIGINT) AS \"end\" FROM part")
def tab_region_scan(spark, sf):
    c = F.col
    both = F.concat_ws("\t", F.concat(F.lit("c"), c("p_partkey") % 5), c("p_partkey").cast("string"), F.when(c("p_partkey") % 3 != 0, (c("p_partkey") + c("p_size")).cast("string")))
    return regions.tab_regions_of(V.table(spark, sf, "part").select(both.alias("value")))


@query("WITH t AS (SELECT *, c_custkey % 4 AS k FROM customer) SELECT 'c' || (c_custkey % 7) AS contig, CASE WHEN k = 0 THEN 'M' ELSE 'F' END AS sex, CAST(c_custkey - 1 AS BIGINT) AS start, CAST(c_custkey + c_nationkey - 1 AS BIGINT) AS stop, CAST(1 + c_custkey % 2 AS INT) AS ploidy FROM t WHERE k <> 3")
def ploidy_ranges(spark, sf):
    c = F.col
    k = c("c_custkey") % 4
    row = F.concat_ws(" ", F.when(k == 3, "*").otherwise(F.concat(F.lit("c"), c("c_custkey") % 7)), F.when(k == 3, "*").otherwise(c("c_custkey").cast("string")), F.when(k == 3, "*").otherwise((c("c_custkey") + c("c_nationkey")).cast("string")), F.when(k == 0, "M").otherwise("F"), (1 + c("c_custkey") % 2).cast("string"))
    return regions.ploidy_table(V.table(spark, sf, "customer").select(row.alias("value")))[0].select("contig", "sex", "start", "stop", "ploidy")


FAMILY = "SELECT CAST(c_custkey AS VARCHAR) AS sample, CAST(c_custkey % 50 AS VARCHAR) AS father, CAST(c_nationkey AS VARCHAR) AS mother, CASE WHEN c_custkey % 2 = 1 THEN 'M' ELSE 'F' END AS sex FROM customer WHERE c_custkey % 50 <> 0 AND c_nationkey <> 0"


@query(FAMILY)
def pedigree_scan(spark, sf):
    c = F.col
    row = F.concat_ws("\t", F.lit("fam"), c("c_custkey").cast("string"), (c("c_custkey") % 50).cast("string"), c("c_nationkey").cast("string"), F.when(c("c_custkey") % 2 == 1, "1").otherwise("2"))
    return regions.families(V.table(spark, sf, "customer").select(row.alias("value")))


FASTA = "q AS (SELECT n_nationkey, n_name, length, substr(repeat('ACGTTGCAAC', 100), 1 + n_nationkey, length) AS s FROM (SELECT *, 137 + 31 * n_nationkey AS length FROM nation))"


def reference(spark, sf, chunk=64):
    """FASTA text of the nations, 60 bases a line, in file order."""
    c = F.col
    n = V.table(spark, sf, "nation").withColumn("length", F.lit(137) + c("n_nationkey") * 31)
    whole = F.substring(F.lit("ACGTTGCAAC" * 100), 1 + c("n_nationkey"), c("length"))
    rows = n.select("n_nationkey", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "n_name", F.lit(" some words"))), F.transform(F.sequence(F.lit(0), F.floor((c("length") - 1) / 60).cast("int")), lambda i: F.substring(whole, i * 60 + 1, F.lit(60))))).alias("i", "value"))
    return regions.fasta_of(rows.coalesce(1).sortWithinPartitions("n_nationkey", "i").select("value"), chunk)


@query(f"WITH {FASTA} SELECT n_name AS contig, CAST(length AS BIGINT) AS length FROM q")
def fasta_lengths(spark, sf):
    return regions.sequence_lengths(reference(spark, sf))


@query(f"WITH {FASTA}, w AS (SELECT o_orderkey, o_custkey % 25 AS k, o_orderkey % 120 AS a, o_orderkey % 120 + o_custkey % 17 AS b FROM orders) SELECT o_orderkey, substr(s, CAST(a + 1 AS INT), CAST(b - a + 1 AS INT)) AS bases, CASE WHEN a < 3 THEN substr(s, 1, CAST(a AS INT)) ELSE substr(s, CAST(a - 2 AS INT), 3) END || 'x' || substr(s, CAST(a + 2 AS INT), 3) AS context FROM w JOIN q ON k = n_nationkey")
def fasta_fetch(spark, sf):
    c = F.col
    n = V.table(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("contig"))
    w = V.table(spark, sf, "orders").select("o_orderkey", (c("o_custkey") % 25).alias("k"), (c("o_orderkey") % 120).alias("start"), (c("o_orderkey") % 120 + c("o_custkey") % 17).alias("stop"))
    ref, w = reference(spark, sf), w.join(n, "k").drop("k")
    got = regions.fetch(ref, w, 64)
    lo = F.greatest(c("start") - 3, F.lit(0))
    near = regions.fetch(ref, w.select("o_orderkey", "contig", lo.alias("start"), (c("start") + 3).alias("stop"), (c("start") - lo).cast("int").alias("at")), 64)
    return got.select("o_orderkey", "bases").join(near.select("o_orderkey", B.sequence_context(c("bases"), c("at")).alias("context")), "o_orderkey")


@query("""WITH r AS (SELECT source, n_chars // 100 AS k, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
  SELECT 'SN' AS section, 'documents' AS key, CAST(sum(n) AS DOUBLE) AS total FROM t UNION ALL SELECT 'RL', CAST(k AS VARCHAR), CAST(sum(n) AS DOUBLE) FROM r GROUP BY 2""")
def statistics_merge(spark, sf):
    d = V.table(spark, sf, "documents")
    sn = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("SN\tdocuments:\t"), F.col("n"), F.lit("\t# of them")).alias("value"))
    rl = d.groupBy("source", F.floor(F.col("n_chars") / 100).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("\t", F.lit("RL"), F.col("k").cast("string"), F.col("n").cast("string")).alias("value"))
    return Q.add_matrices(regions.sections_of(sn.unionByName(rl)), ["section", "key"]).select("section", "key", F.col("values")[0].alias("total"))


@query("SELECT CASE WHEN k = 0 THEN 'SN' || chr(9) || 'orders:' || chr(9) || n ELSE 'IS' || chr(9) || k || chr(9) || n END AS line FROM (SELECT o_custkey % 40 AS k, count(*) AS n FROM orders GROUP BY 1)")
def statistics_text(spark, sf):
    rows = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    first = F.col("k") == 0
    return sinks.statistics_lines(rows.select(F.when(first, "SN").otherwise("IS").alias("section"), F.when(first, "orders").otherwise(F.col("k").cast("string")).alias("key"), F.array(F.col("n").cast("double")).alias("values")))


@query(W + """, z AS (SELECT *, partkey % 4 AS s, len // 2 AS half, 1 + suppkey % 3 AS gap, partkey % 3 AS ins, CAST(floor(price) AS INT) % 70 - 5 AS rel FROM reads)
  SELECT tid, CAST(sum(CASE WHEN half = 0 AND rel < 0 THEN s + ins WHEN rel < 0 THEN s WHEN rel < half THEN s + rel WHEN rel < half + gap THEN s + half WHEN rel < len + gap THEN s + half + ins + rel - half - gap ELSE s + ins + len END) AS BIGINT) AS query_sum, CAST(sum(CASE WHEN s > 0 THEN 11 - s ELSE 11 END) AS BIGINT) AS place_sum, CAST(sum(len + ins) AS BIGINT) AS aligned FROM z GROUP BY tid""")
def read_offsets(spark, sf):
    e = R.cigar_elements(F.col("cigar"))
    r = V.reads(spark, sf).withColumn("e", e).withColumn("rel", F.floor("price").cast("int") % 70 - 5)
    at = indel.query_position(F.col("e"), F.col("pos"), F.col("pos") + F.col("rel"))
    return r.groupBy("tid").agg(F.sum(at).cast("long").alias("query_sum"), F.sum(R.read_position(F.lit(10), F.col("e"))).cast("long").alias("place_sum"), F.sum(R.aligned_read_length(F.col("e"))).cast("long").alias("aligned"))


@query("WITH x AS (SELECT DISTINCT p_size % 11 - 5 AS length, p_size % 7 AS run FROM part) SELECT length, run, CAST(least(40 + 20 * (abs(length) - 1), CASE WHEN run >= 3 THEN CAST(floor(100.0 * abs(length) / run + 0.499) AS INT) ELSE 1000 END) AS INT) AS quality FROM x WHERE length <> 0")
def indel_sequencing_quality(spark, sf):
    x = V.table(spark, sf, "part").select((F.col("p_size") % 11 - 5).alias("length"), (F.col("p_size") % 7).alias("run")).distinct().filter("length != 0")
    return x.withColumn("quality", R.indel_quality(40, 20, 100, F.col("length"), F.col("run")).cast("int"))


@query("WITH x AS (SELECT DISTINCT o_custkey % 9 AS k, o_orderkey % 13 AS n FROM orders) SELECT k, n, CAST(CASE WHEN k = 0 THEN 0 ELSE n END AS INT) AS extent FROM x")
def repeat_extents(spark, sf):
    x = V.table(spark, sf, "orders").select((F.col("o_custkey") % 9).alias("k"), (F.col("o_orderkey") % 13).alias("n")).distinct()
    ref = F.concat(F.lit("G"), F.expr("substring(repeat('ACT', 10), 1, int(n))"), F.lit("GGGG"))
    unit = F.expr("substring('ACTACTACTACT', 1, 3)")
    return x.withColumn("extent", F.when(F.col("k") == 0, indel.repeat_extent(ref, F.lit(0), F.lit(1), F.lit("N"))).otherwise(indel.repeat_extent(ref, F.lit(0), F.lit(3), unit)))


@query("""WITH g AS (SELECT DISTINCT o_orderkey % 6 AS x, o_custkey % 6 AS y FROM orders) SELECT x, y, CAST(greatest(x, y) * (greatest(x, y) + 1) // 2 + least(x, y) AS INT) AS i, CAST(least(x, y) AS INT) AS a, CAST(greatest(x, y) AS INT) AS b, CAST((1 << CAST(x AS INT)) | (1 << CAST(y AS INT)) AS INT) AS mask,
  CAST(greatest(x, y) * (greatest(x, y) + 1) // 2 + greatest(x, y) AS INT) AS homozygous FROM g""")
def genotype_algebra(spark, sf):
    g = V.table(spark, sf, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("x"), (F.col("o_custkey") % 6).cast("int").alias("y")).distinct()
    i = B.genotype_index(F.col("x"), F.col("y"))
    hi = F.greatest("x", "y")
    pl = F.sequence(F.lit(0), F.lit(20))
    own = A.trim_likelihoods(pl, F.array_distinct(F.array(F.lit(0), hi)))
    kept = A.allele_mask(F.array_distinct(F.array("x", "y")))
    return g.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), i.alias("i"), B.genotype_alleles(i)["a"].alias("a"), B.genotype_alleles(i)["b"].alias("b"), kept.alias("mask"), F.element_at(own, -1).alias("homozygous"))


@query("SELECT o_orderkey, CASE WHEN abs(v) < 0.0005 THEN '0' ELSE regexp_replace(printf('%.3f', v), '\\.?0+$', '') END AS three, round(v, 1) + 0.0 AS one, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS big FROM (SELECT *, (o_custkey % 4000) / 8000.0 - 0.1 AS v FROM orders)")
def number_text(spark, sf):
    v = (F.col("o_custkey") % 4000) / 8000.0 - 0.1
    return V.table(spark, sf, "orders").select("o_orderkey", X.round_nearest_text(v, 3).alias("three"), (X.round_nearest(v, 1) + 0.0).alias("one"), X.thousands(F.floor("o_totalprice")).alias("big"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'unmapped' WHEN o_custkey % 5 = 1 THEN 'c' || (o_orderkey % 7) WHEN o_custkey % 5 = 2 THEN 'c' || (o_orderkey % 7) || ':' || o_custkey ELSE 'c' || (o_orderkey % 7) || ':' || o_custkey || '-' || (o_custkey + 9) END AS locus FROM orders")
def locus_labels(spark, sf):
    k, c = F.col("o_custkey") % 5, F.col("o_custkey")
    contig = F.when(k != 0, F.concat(F.lit("c"), F.col("o_orderkey") % 7))
    return V.table(spark, sf, "orders").select("o_orderkey", X.locus_text(contig, F.when(k > 1, c), F.when(k == 2, c).otherwise(c + 9)).alias("locus"))


@query("""WITH a AS (SELECT DISTINCT p_partkey % 8 AS k, ['.', '-', '', '<DEL>', 'A[c1:5[', ']c1:5]A', 'ACGT', '<>'][CAST(p_partkey % 8 + 1 AS INT)] AS allele FROM part)
  SELECT k, allele, allele = '.' AS no_call, allele IN ('-', '') AS is_null, length(allele) > 2 AND ((allele LIKE '<%' AND allele LIKE '%>') OR contains(allele, '[') OR contains(allele, ']')) AS symbolic FROM a""")
def allele_kinds(spark, sf):
    kinds = F.array(*[F.lit(x) for x in (".", "-", "", "<DEL>", "A[c1:5[", "]c1:5]A", "ACGT", "<>")])
    a = V.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("k")).distinct().withColumn("allele", F.get(kinds, F.col("k").cast("int")))
    x = F.col("allele")
    return a.select("k", "allele", X.no_call(x).alias("no_call"), X.null_allele(x).alias("is_null"), X.symbolic_allele(x).alias("symbolic"))


@query(W + ", o AS (SELECT tid, pos, pos + len - 1 AS stop, lag(tid) OVER w AS pt, lag(pos) OVER w AS pp, lag(pos + len - 1) OVER w AS ps FROM reads WINDOW w AS (ORDER BY pos, qid, partkey, suppkey, price)) SELECT tid, count(*) FILTER (WHERE tid > pt OR (tid = pt AND pos > ps)) AS past, count(*) FILTER (WHERE tid < pt OR (tid = pt AND stop < pp)) AS before FROM o GROUP BY tid")
def interval_order(spark, sf):
    from pyspark.sql import Window

    # the window over all reads is the query's own: it numbers them once and joins neighbours by number
    w = Window.orderBy("pos", "qid", "partkey", "suppkey", "price")
    o = V.reads(spark, sf).select("tid", "pos", "qid", "partkey", "suppkey", "price", (F.col("pos") + F.col("len") - 1).alias("stop"))
    o = o.withColumns({"pt": F.lag("tid").over(w), "pp": F.lag("pos").over(w), "ps": F.lag("stop").over(w)})
    return o.groupBy("tid").agg(F.count_if(I.is_past(F.col("tid"), F.col("pos"), F.col("pt"), F.col("ps"))).alias("past"), F.count_if(I.is_before(F.col("tid"), F.col("stop"), F.col("pt"), F.col("pp"))).alias("before"))


@query("SELECT CAST(l_linenumber AS INT) AS line, round(sum(pow(10, -(2 + l_partkey % 40) / 10.0)), 6) AS errors FROM lineitem GROUP BY 1")
def error_probabilities(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(F.round(F.sum(B.error_probability((2 + F.col("l_partkey") % 40).cast("double"))), 6).alias("errors"))


@query("""WITH RECURSIVE r AS (SELECT 0 AS i, CAST(xor(1111111, 25214903917) AS HUGEINT) AS s UNION ALL SELECT i + 1, (s * 25214903917 + 11) % 281474976710656 FROM r WHERE i < 400)
  SELECT i - 1 AS i, CAST(CASE WHEN s // 65536 >= 2147483648 THEN s // 65536 - 4294967296 ELSE s // 65536 END AS BIGINT) AS value FROM r WHERE i > 0""")
def java_random(spark, sf):
    rng = JavaRandom(1111111)
    return spark.createDataFrame([(i, rng.next_int()) for i in range(400)], "i int, value bigint")


@query(W + """, p AS (SELECT tid, pos // 50 AS p, count(*) FILTER (WHERE partkey % 3 > 0 AND NOT rev) AS a, count(*) FILTER (WHERE partkey % 3 > 0 AND rev) AS b, count(*) FILTER (WHERE partkey % 3 = 0 AND NOT rev) AS c, count(*) FILTER (WHERE partkey % 3 = 0 AND rev) AS d FROM reads WHERE NOT dup AND partkey % 20 = 0 GROUP BY ALL),
  t AS (SELECT DISTINCT a, b, c, d FROM p), f AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM t),
  x AS (SELECT *, unnest(generate_series(greatest(0, r + k - n), least(r, k))) AS x FROM f),
  v AS (SELECT *, CASE WHEN x = a THEN 1 ELSE 0 END AS own, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1)) AS p FROM x),
  o AS (SELECT *, max(CASE WHEN own = 1 THEN p END) OVER (PARTITION BY a, b, c, d) AS p0 FROM v)
  SELECT a, b, c, d, CAST(CASE WHEN least(a + b, c + d, a + c, b + d) < 2 THEN 0 ELSE least(255, floor(-4.343 * ln(greatest(sum(CASE WHEN p <= p0 * (1 + 1e-7) THEN p END), 1e-300)) + 0.499)) END AS INT) AS sp FROM o GROUP BY a, b, c, d""")
def fisher_tables(spark, sf):
    same, rev = F.col("partkey") % 3 > 0, F.col("rev")
    r = placed(spark, sf).filter(F.col("partkey") % 20 == 0).groupBy("tid", F.floor(F.col("pos") / 50).alias("p"))
    t = r.agg(F.count_if(same & ~rev).alias("a"), F.count_if(same & rev).alias("b"), F.count_if(~same & ~rev).alias("c"), F.count_if(~same & rev).alias("d")).select("a", "b", "c", "d").distinct()
    return t.withColumn("sp", bias.fisher_column(*[F.col(x) for x in "abcd"]))


@query(ALN + """, y AS (SELECT *, row_number() OVER () AS rid, pos + len + gap - 1 AS stop, CAST(s AS FLOAT) / CAST(s + len + gap + ins AS FLOAT) >= CAST(0.3 AS FLOAT) AS heavy FROM z WHERE mapq > 0 AND flag & 1796 = 0),
  d AS (SELECT *, CASE WHEN isize <> 0 AND flag & 1 <> 0 AND flag & 4 = 0 AND flag & 8 = 0 AND (flag & 16 <> 0) <> (flag & 32 <> 0) AND (CASE WHEN flag & 16 <> 0 THEN stop > mate_pos ELSE pos <= mate_pos + isize END) THEN CASE WHEN flag & 16 <> 0 THEN mate_pos - 1 ELSE pos + abs(isize) + 1 END END AS beside FROM y),
  b AS (SELECT *, pos + k AS p, s + k AS off, false AS del FROM (SELECT *, unnest(generate_series(0, half - 1)) AS k FROM d)
    UNION ALL SELECT *, pos + half + k AS p, s + half - 1 AS off, true AS del FROM (SELECT *, unnest(generate_series(0, gap - 1)) AS k FROM d)
    UNION ALL SELECT *, pos + half + gap + k AS p, s + half + ins + k AS off, false AS del FROM (SELECT *, unnest(generate_series(0, len - half - 1)) AS k FROM d)),
  c AS (SELECT *, CASE WHEN del THEN 'D' ELSE substr(seq, CAST(off + 1 AS INT), 1) END AS base, substr('ACGTTGCAAC', CAST((tid + p) % 10 + 1 AS INT), 1) AS ref FROM b),
  e AS (SELECT * FROM c WHERE base <> 'N' AND NOT coalesce(isize <= 100 AND (CASE WHEN flag & 16 <> 0 THEN p <= beside ELSE p >= beside END), false)),
  f AS (SELECT *, NOT heavy AND sum(CASE WHEN NOT del AND base <> ref THEN quality ELSE 0 END) OVER (PARTITION BY rid) <= 100 AS clean FROM e)
  SELECT 'c' || tid AS contig, CAST(p AS INT) AS p, ref, count(*) AS n, count(*) FILTER (WHERE del) AS n_del, count(*) FILTER (WHERE NOT del AND base <> ref) AS n_alt, count(*) FILTER (WHERE clean) AS n_clean, CAST(sum(off) AS BIGINT) AS offsets FROM f GROUP BY 1, 2, 3""")
def records_pile(spark, sf):
    ref = pattern(spark)
    r = sam.records(alignments(spark, sf)).withColumns({"tid": F.substring("contig", 2, 9).cast("int"), "sample": F.lit("TUMOR")})
    rows = plan.pile(r, ref, chunk=512, fold=False)
    odd = ~F.col("is_del") & (F.col("base") != F.col("ref"))
    return rows.groupBy("contig", "p", "ref").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_del").alias("n_del"), F.count_if(odd).alias("n_alt"), F.count_if("clean").alias("n_clean"), F.sum("offset").cast("long").alias("offsets"))


def pattern(spark, chunk=512):
    """FASTA text of seven contigs of one repeated pattern."""
    whole = F.expr("substring(repeat('ACGTTGCAAC', 272), int(tid) + 1, 2700)")
    text = spark.range(7).withColumnRenamed("id", "tid").select("tid", F.posexplode(F.concat(F.array(F.concat(F.lit(">c"), "tid")), F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.substring(whole, i * 60 + 1, F.lit(60))))).alias("i", "value"))
    return regions.fasta_of(text.coalesce(1).sortWithinPartitions("tid", "i").select("value"), chunk)


@query(ALN + """, y AS (SELECT *, row_number() OVER () AS rid FROM z WHERE mapq > 0),
  b AS (SELECT rid, tid, quality, seq, pos + k AS p, s + k AS off FROM (SELECT *, unnest(generate_series(0, half - 1)) AS k FROM y) UNION ALL SELECT rid, tid, quality, seq, pos + half + gap + k AS p, s + half + ins + k AS off FROM (SELECT *, unnest(generate_series(0, len - half - 1)) AS k FROM y)),
  c AS (SELECT rid, least(quality, 33) AS q, quality >= 13 AS good, substr(seq, CAST(off + 1 AS INT), 1) AS base, substr('ACGTTGCAAC', CAST((tid + p) % 10 + 1 AS INT), 1) AS ref FROM b),
  e AS (SELECT rid, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND base <> 'N' AND base <> ref) AS m, coalesce(sum(q) FILTER (WHERE good AND base <> 'N' AND base <> ref), 0) AS cost FROM c GROUP BY rid),
  t AS (SELECT tid, qid, cost - 4.343 * (CASE WHEN m > 0 THEN m * ln(greatest(n, 1)) - lgamma(m + 1) ELSE 0 END) + s * quality / 5.0 AS t FROM y JOIN e USING (rid))
  SELECT CASE WHEN t > 400 THEN -1 ELSE CAST(floor(sqrt((400 - greatest(t, 0)) / 400) * 400 + 0.499) AS INT) END AS cap, count(*) AS n FROM t GROUP BY 1""")
def mapping_quality_cap(spark, sf):
    r = sam.records(alignments(spark, sf))
    return plan.capped_quality(r, pattern(spark), 400, 512).groupBy("cap").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT o_orderkey, repeat('A', CAST(o_custkey % 4 AS INT)) || repeat('C', CAST(1 + o_orderkey % 5 AS INT)) || 'G' AS ref, CAST(o_custkey % 3 AS INT) AS p FROM orders),
  y AS (SELECT *, substr(ref, p + 2, 1) AS b, substr(ref, 1, p + 2) AS u, substr(ref, p + 3) AS v FROM x)
  SELECT o_orderkey, CAST(CASE WHEN p + 1 < length(ref) THEN length(u) - length(rtrim(u, b)) + length(v) - length(ltrim(v, b)) ELSE 0 END AS INT) AS run FROM y""")
def homopolymer_runs(spark, sf):
    c = F.col
    ref = F.concat(F.expr("repeat('A', int(o_custkey % 4))"), F.expr("repeat('C', int(1 + o_orderkey % 5))"), F.lit("G"))
    return V.table(spark, sf, "orders").select("o_orderkey", indel.homopolymer_run(ref, (c("o_custkey") % 3).cast("int")).alias("run"))


@query("""WITH x AS (SELECT DISTINCT o_custkey % 4 AS i, o_orderkey % 4 AS j FROM orders), a AS (SELECT *, ['C', 'CT', 'CTA', 'G'][CAST(i + 1 AS INT)] AS r1, ['C', 'CT', 'CTA', 'G'][CAST(j + 1 AS INT)] AS r2 FROM x),
  b AS (SELECT *, r1 || 'T' AS s1, r2 || 'T' AS s2, CASE WHEN starts_with(r1, r2) THEN substr(r1, length(r2) + 1) WHEN starts_with(r2, r1) THEN substr(r2, length(r1) + 1) END AS tail FROM a),
  m AS (SELECT i, j, tail, CASE WHEN length(r2) > length(r1) THEN [r1 || tail, s1 || tail] ELSE [r1, s1] END AS mine, CASE WHEN length(r1) > length(r2) THEN [r2 || tail, s2 || tail] ELSE [r2, s2] END AS want FROM b)
  SELECT i, j, CAST(CASE WHEN tail IS NULL THEN -1 ELSE coalesce(nullif(list_position(mine, want[1]), 0), 0) - 1 END AS INT) AS ref_at, CAST(CASE WHEN tail IS NULL THEN -1 ELSE coalesce(nullif(list_position(mine, want[2]), 0), 0) - 1 END AS INT) AS alt_at FROM m""")
def allele_positions(spark, sf):
    c = F.col
    refs = F.array(*[F.lit(x) for x in ("C", "CT", "CTA", "G")])
    pair = lambda k: F.array(F.get(refs, c(k).cast("int")), F.concat(F.get(refs, c(k).cast("int")), F.lit("T")))
    x = V.table(spark, sf, "orders").select((c("o_custkey") % 4).alias("i"), (c("o_orderkey") % 4).alias("j")).distinct()
    x = x.withColumn("at", A.allele_map(pair("i"), pair("j")))
    return x.select("i", "j", c("at")[0].alias("ref_at"), c("at")[1].alias("alt_at"))


@query(ALN + " SELECT 'c' || tid AS contig, CAST(pos + half - 1 AS INT) AS p, CAST(-gap AS INT) AS length, count(*) AS n FROM z WHERE mapq > 0 AND half > 0 GROUP BY 1, 2, 3")
def indel_events(spark, sf):
    from ..plans import indels

    r = sam.records(alignments(spark, sf)).filter(F.col("contig").isNotNull())
    v = r.select("contig", "pos", F.explode(indels.events(R.cigar_elements(F.col("cigar")), F.col("seq"))).alias("v"))
    return v.groupBy("contig", (F.col("pos") + F.col("v.ref0")).cast("int").alias("p"), F.col("v.length").alias("length")).agg(F.count(F.lit(1)).alias("n"))
