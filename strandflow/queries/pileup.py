"""Queries over the alignment view, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SomaticConfig
from ..functions import bases as B
from ..functions import reads as R
from ..functions import text as X
from ..operators import likelihood as L
from ..operators import pileup as P
from ..operators.power import with_power
from ..plans import alignment_view as V
from ..plans import somatic as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


W = f"WITH {V.READS}"
WP = f"WITH {V.READS}, {V.pile_sql()}"
WT = f"WITH {V.READS}, {V.pile_sql('NOT dup AND mapq > 0')}"


def placed(spark, sf):
    return V.reads(spark, sf).filter(~F.col("dup"))


def pile(spark, sf, *keep):
    return V.pile(placed(spark, sf), *keep)


def tumor_pile(spark, sf):
    return V.pile(placed(spark, sf).filter(F.col("mapq") > 0))


@query(W + """ SELECT tid, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN flag & 1796 = 0 AND pos >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_walk,
  CAST(sum(CASE WHEN flag & 4 = 0 AND flag & 1796 = 0 AND mapq >= 14 AND NOT (flag & 1 <> 0 AND flag & 2 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS n_germline,
  CAST(sum(CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rev FROM reads GROUP BY tid""")
def read_filter_flags(spark, sf):
    r, f = V.reads(spark, sf), F.col("flag")
    return r.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.placed_read(f, F.col("pos"))).alias("n_walk"), F.count_if(R.germline_read(f, F.col("mapq"), 1796, 0, 14)).alias("n_germline"), F.count_if(R.has(f, R.REVERSE)).alias("n_rev"))


CIGAR = """, el AS (SELECT qid, partkey, suppkey, price, tid, pos, cigar, flag, mate_pos, isize, list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])'), lambda e: {'op': e[-1], 'len': CAST(e[:-2] AS INT)}) AS els FROM reads)"""


@query(W + CIGAR + """ SELECT qid, partkey, suppkey, price, cigar, CAST(pos - 1 + list_sum(list_transform(els, lambda e: CASE WHEN contains('MDN=X', e.op) THEN e.len ELSE 0 END)) AS INT) AS stop,
  CAST(list_sum(list_transform(els, lambda e: CASE WHEN contains('MIS=X', e.op) THEN e.len ELSE 0 END)) AS INT) AS read_len, CAST(len(els) AS INT) AS n_ops FROM el""")
def cigar_parse_end(spark, sf):
    e = F.col("els")
    r = V.reads(spark, sf).withColumn("els", R.cigar_elements(F.col("cigar")))
    return r.select("qid", "partkey", "suppkey", "price", R.cigar_text(e).alias("cigar"), R.alignment_end(F.col("pos"), e).alias("stop"), R.read_length(e).alias("read_len"), F.size(e).alias("n_ops"))


@query(W + """, x AS (SELECT tid, pos, len, len // 2 AS a, 1 + suppkey % 3 AS d, partkey % 4 AS s, partkey % 3 AS i FROM reads),
  u AS (SELECT tid, pos + unnest(generate_series(0, a + d + len - a - 1)) AS p, a, d, pos FROM x)
  SELECT tid, CAST(p AS INT) AS p, count(*) AS depth, CAST(sum(CASE WHEN p - pos >= a AND p - pos < a + d THEN 1 ELSE 0 END) AS BIGINT) AS n_del FROM u GROUP BY tid, p""")
def cigar_unnest(spark, sf):
    return P.depth_by_boundaries(P.block_spans(V.reads(spark, sf), ["tid"]), weights={"n_del": F.col("is_del")})


@query(W + CIGAR + """, b AS (SELECT *, CAST(pos - 1 + list_sum(list_transform(els, lambda e: CASE WHEN contains('MDN=X', e.op) THEN e.len ELSE 0 END)) AS INT) AS stop FROM el),
  c AS (SELECT *, isize <> 0 AND flag & 1 <> 0 AND flag & 4 = 0 AND flag & 8 = 0 AND (flag & 16 <> 0) <> (flag & 32 <> 0) AND (CASE WHEN flag & 16 <> 0 THEN stop > mate_pos ELSE pos <= mate_pos + isize END) AS ok FROM b),
  d AS (SELECT *, CASE WHEN ok THEN CASE WHEN flag & 16 <> 0 THEN mate_pos - 1 ELSE pos + abs(isize) + 1 END END AS boundary FROM c)
  SELECT tid, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_well, CAST(sum(boundary) AS BIGINT) AS sum_boundary,
  CAST(sum(CASE WHEN boundary IS NOT NULL AND isize <= 100 AND (CASE WHEN flag & 16 <> 0 THEN stop <= boundary ELSE stop >= boundary END) THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM d GROUP BY tid""")
def adaptor_boundary(spark, sf):
    r = V.reads(spark, sf).withColumn("stop", R.alignment_end(F.col("pos"), R.cigar_elements(F.col("cigar"))))
    args = (F.col("flag"), F.col("pos"), F.col("stop"), F.col("mate_pos"), F.col("isize"))
    r = r.withColumn("ok", R.well_defined_fragment(*args)).withColumn("boundary", R.adaptor_boundary(*args))
    inside = R.inside_adaptor(F.col("stop"), F.col("boundary"), F.col("flag"), F.col("isize"))
    return r.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_well"), F.sum("boundary").alias("sum_boundary"), F.count_if(inside).alias("n_inside"))


@query(W + """, x AS (SELECT tid, partkey % 4 AS s, partkey % 4 + len + 1 + suppkey % 3 + partkey % 3 AS total FROM reads)
  SELECT tid, CAST(sum(s) AS BIGINT) AS clipped, CAST(sum(CASE WHEN CAST(s AS FLOAT) / CAST(total AS FLOAT) >= CAST(0.3 AS FLOAT) THEN 1 ELSE 0 END) AS BIGINT) AS n_heavy FROM x GROUP BY tid""")
def soft_clip_fraction(spark, sf):
    e = R.cigar_elements(F.col("cigar"))
    heavy = R.heavily_clipped(e, SomaticConfig().heavily_clipped_read_fraction)
    s = F.aggregate(F.filter(e, lambda x: x["op"] == "S"), F.lit(0), lambda a, x: a + x["len"])
    return V.reads(spark, sf).groupBy("tid").agg(F.sum(s).alias("clipped"), F.count_if(heavy).alias("n_heavy"))


@query(WP + """ SELECT qid, partkey, suppkey, price, CAST(sum(CASE WHEN base <> ref THEN quality ELSE 0 END) AS BIGINT) AS mismatch_quality FROM pile WHERE abs(p - (pos + 3)) <= 150 GROUP BY qid, partkey, suppkey, price""")
def mismatch_quality_window(spark, sf):
    return P.window_mismatch_quality(pile(spark, sf), ["qid", "partkey", "suppkey", "price"], F.col("pos") + 3)


@query(WP + " SELECT tid, p, count(*) AS depth FROM pile GROUP BY tid, p")
def pileup_depth(spark, sf):
    spans = placed(spark, sf).select("tid", F.col("pos").alias("start"), (F.col("pos") + F.col("len") - 1).alias("stop"))
    return P.depth_by_boundaries(spans)


IV = "iv AS (SELECT tid, min(pos) - 5 AS a, max(pos) + 55 AS b FROM reads GROUP BY tid)"


@query(WP + f", {IV}, d AS (SELECT tid, p, count(*) AS depth FROM pile GROUP BY tid, p), g AS (SELECT tid, CAST(unnest(generate_series(a, b)) AS INT) AS p FROM iv) SELECT g.tid, g.p, coalesce(d.depth, 0) AS depth FROM g LEFT JOIN d USING (tid, p)")
def pileup_zero_filled(spark, sf):
    r = V.reads(spark, sf)
    iv = r.groupBy("tid").agg((F.min("pos") - 5).alias("start"), (F.max("pos") + 55).alias("stop"))
    return P.zero_filled(pileup_depth(spark, sf), iv)


@query(WP + f", {IV}, d AS (SELECT tid, p, count(*) AS depth FROM pile GROUP BY tid, p), g AS (SELECT tid, CAST(unnest(generate_series(a, b)) AS INT) AS p FROM iv) SELECT round(CAST(sum(coalesce(d.depth, 0)) AS DOUBLE) / count(*), 6) AS coverage FROM g LEFT JOIN d USING (tid, p)")
def mean_coverage(spark, sf):
    return pileup_zero_filled(spark, sf).agg(F.round(F.sum("depth") / F.count(F.lit(1)), 6).alias("coverage"))


@query(WP + """ SELECT tid, p, count(*) FILTER (WHERE base = 'A') AS n_a, count(*) FILTER (WHERE base = 'C') AS n_c, count(*) FILTER (WHERE base = 'G') AS n_g, count(*) FILTER (WHERE base = 'T') AS n_t,
  CAST(0 AS BIGINT) AS n_del, count(*) FILTER (WHERE mapq = 0) AS n_mq0, max(mapq) AS max_mapq FROM pile GROUP BY tid, p""")
def pileup_base_counts(spark, sf):
    return pile(spark, sf).groupBy("tid", "p").agg(*P.base_counts(F.col("is_del")))


@query(WP + """ SELECT tid, p, count(*) FILTER (WHERE base = ref AND NOT rev) AS ref_fwd, count(*) FILTER (WHERE base = ref AND rev) AS ref_rev, count(*) FILTER (WHERE base <> ref AND NOT rev) AS alt_fwd, count(*) FILTER (WHERE base <> ref AND rev) AS alt_rev,
  '(' || count(*) FILTER (WHERE base = ref AND NOT rev) || ',' || count(*) FILTER (WHERE base = ref AND rev) || ',' || count(*) FILTER (WHERE base <> ref AND NOT rev) || ',' || count(*) FILTER (WHERE base <> ref AND rev) || ')' AS strand_text
  FROM pile WHERE quality >= 5 GROUP BY tid, p""")
def pileup_strand_table(spark, sf):
    same = F.col("base") == F.col("ref")
    t = pile(spark, sf).filter(P.passes(min_base=5)).groupBy("tid", "p").agg(F.count_if(same & ~F.col("rev")).alias("ref_fwd"), F.count_if(same & F.col("rev")).alias("ref_rev"), F.count_if(~same & ~F.col("rev")).alias("alt_fwd"), F.count_if(~same & F.col("rev")).alias("alt_rev"))
    return t.withColumn("strand_text", X.strand_text(F.col("ref_fwd"), F.col("ref_rev"), F.col("alt_fwd"), F.col("alt_rev")))


FOLD = """, g AS (SELECT tid, p, qid, list({'o0': pos, 'o1': qid, 'o2': partkey, 'o3': suppkey, 'o4': price, 'base': base, 'ref': ref, 'quality': quality, 'mapq': mapq, 'rev': rev, 'sample': sample} ORDER BY pos, qid, partkey, suppkey, price) AS l FROM pile GROUP BY tid, p, qid),
  f AS (SELECT tid, p, unnest(CASE WHEN len(l) = 1 THEN l ELSE [list_reduce(l, lambda a, x: CASE WHEN a IS NULL THEN x WHEN a.base <> x.base THEN CASE WHEN {retain} THEN CASE WHEN x.base <> x.ref THEN x ELSE a END ELSE NULL END WHEN a.quality < x.quality THEN x ELSE a END)] END) AS r FROM g)"""


def folded(spark, sf, retain):
    rows = placed(spark, sf).select("tid", "qid", "pos", "len", "partkey", "suppkey", "price", "mapq", "quality", "rev", "sample").withColumn("stop", F.col("pos") + F.col("len") - 1)
    return P.overlap_filter(V.pile(P.mate_counts(rows), "mates"), V.ORDER, retain=retain)


@query(WP + FOLD.replace("{retain}", "true") + " SELECT tid, p, count(*) AS depth, count(*) FILTER (WHERE r.base <> r.ref) AS n_alt, CAST(sum(r.quality) AS BIGINT) AS q_sum FROM f WHERE r IS NOT NULL GROUP BY tid, p")
def overlap_dedup(spark, sf):
    return folded(spark, sf, True).groupBy("tid", "p").agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("base") != F.col("ref")).alias("n_alt"), F.sum("quality").alias("q_sum"))


@query(WP + FOLD.replace("{retain}", "false") + " SELECT tid, p, count(*) AS depth, CAST(sum(r.quality) AS BIGINT) AS q_sum FROM f WHERE r IS NOT NULL GROUP BY tid, p")
def overlap_dedup_drop_mismatches(spark, sf):
    return folded(spark, sf, False).groupBy("tid", "p").agg(F.count(F.lit(1)).alias("depth"), F.sum("quality").alias("q_sum"))


@query(WP + FOLD.replace("{retain}", "x.sample = 'NORMAL'") + """ SELECT tid, p, count(*) AS initial, count(*) FILTER (WHERE r.quality >= 5) AS quality_filtered, count(*) FILTER (WHERE r.quality >= 5 AND r.mapq > 0) AS final,
  count(*) FILTER (WHERE r.quality >= 20 AND r.mapq > 0) AS q20, count(*) FILTER (WHERE r.quality >= 5 AND r.mapq = 0) AS mq0 FROM f WHERE r IS NOT NULL GROUP BY tid, p""")
def locus_pile_markers(spark, sf):
    q, m = F.col("quality"), F.col("mapq")
    return folded(spark, sf, F.col("sample") == "NORMAL").groupBy("tid", "p").agg(F.count(F.lit(1)).alias("initial"), F.count_if(q >= 5).alias("quality_filtered"), F.count_if((q >= 5) & (m > 0)).alias("final"), F.count_if((q >= 20) & (m > 0)).alias("q20"), F.count_if((q >= 5) & (m == 0)).alias("mq0"))


@query(WP + """ SELECT tid, p, base, count(*) AS n, CAST(sum(quality) AS BIGINT) AS q_sum, CAST(max(t) - sum(quality) AS BIGINT) AS q_other
  FROM (SELECT *, sum(quality) OVER (PARTITION BY tid, p) AS t FROM pile WHERE mapq > 0 AND quality > 13) GROUP BY tid, p, base""")
def quality_sums(spark, sf):
    ok = (F.col("mapq") > 0) & (F.col("quality") > SomaticConfig().min_qsum_qscore)
    per = pile(spark, sf).filter(ok).groupBy("tid", "p", "base").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q_sum"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["q_sum"])
    loci = per.groupBy("tid", "p").agg(F.collect_list(F.struct("base", "n", "q_sum")).alias("all"))
    return loci.select("tid", "p", total.alias("t"), F.explode("all").alias("b")).select("tid", "p", "b.base", "b.n", "b.q_sum", (F.col("t") - F.col("b.q_sum")).alias("q_other"))


@query(W + """, x AS (SELECT tid, qid, partkey % 4 AS s, len // 2 AS a, 1 + suppkey % 3 AS d, partkey % 3 AS i, len FROM reads),
  o AS (SELECT *, unnest(generate_series(0, len - 1)) AS k FROM x),
  z AS (SELECT *, s + CASE WHEN k < a THEN k ELSE k + i END AS off FROM o)
  SELECT tid, CAST(off AS INT) AS offset, count(*) FILTER (WHERE abs(s + a - off) <= 5) AS n_del, count(*) FILTER (WHERE abs(s + a - off) > 5 AND i > 0 AND abs(s + a + d - off) <= 5) AS n_ins FROM z GROUP BY tid, off""")
def gap_events(spark, sf):
    rows = P.unnest(V.reads(spark, sf).withColumn("els", R.cigar_elements(F.col("cigar"))), ["tid", "els"]).filter(~F.col("is_del"))
    hit = P.gap_event(F.col("els"), F.col("offset"))
    return rows.select("tid", "offset", hit.alias("hit")).groupBy("tid", "offset").agg(F.count_if(F.col("hit") == "D").alias("n_del"), F.count_if(F.col("hit") == "I").alias("n_ins"))


def histograms(spark, sf):
    return P.quality_histogram(tumor_pile(spark, sf), also=["ref"])


COUNTS = ", c AS (SELECT tid, p, ref, substr('ACGT', CAST(1 + (tid * 7 + p * 3 + 1) % 4 AS INT), 1) AS alt, count(*) FILTER (WHERE base = ref) AS n_ref, count(*) FILTER (WHERE base <> ref) AS n_alt FROM pile GROUP BY tid, p, ref), fr AS (SELECT *, CASE WHEN n_ref + n_alt = 0 THEN 0 ELSE n_alt / (n_ref + n_alt) END AS f FROM c)"
LL = "CASE WHEN {b} = {r} THEN CASE WHEN {f} * e / 3 + (1 - {f}) * (1 - e) > 0 THEN log10({f} * e / 3 + (1 - {f}) * (1 - e)) ELSE '-infinity'::DOUBLE END WHEN {b} = {a} THEN CASE WHEN {f} * (1 - e) + (1 - {f}) * e / 3 > 0 THEN log10({f} * (1 - e) + (1 - {f}) * e / 3) ELSE '-infinity'::DOUBLE END ELSE 0 END"
ll = lambda f: LL.replace("{f}", f).replace("{b}", "base").replace("{r}", "pile.ref").replace("{a}", "alt")


@query(WT + COUNTS + " SELECT tid, p, ref, alt, n_ref, n_alt, round(f, 6) AS f FROM fr WHERE n_alt > 0")
def allele_fraction(spark, sf):
    h = L.alternatives(histograms(spark, sf))
    f = L.allele_fraction(F.col("hist"), F.col("ref"), F.col("alt"))
    n = L.count_of(F.col("hist"), F.col("alt"))
    return h.filter(n > 0).select("tid", "p", "ref", "alt", L.count_of(F.col("hist"), F.col("ref")).alias("n_ref"), n.alias("n_alt"), F.round(f, 6).alias("f"))


@query(WT + COUNTS + f", s AS (SELECT tid, p, alt, f, sum({ll('f')}) AS l1, sum({ll('0')}) AS l0, sum({ll('0.1')}) AS l01 FROM (SELECT *, pow(10, -quality / 10.0) AS e FROM pile) pile JOIN fr USING (tid, p) WHERE n_alt > 0 GROUP BY tid, p, alt, f) SELECT tid, p, alt, round(l1 - l0, 6) AS lod, round(l01 - l0, 6) AS lod_tenth FROM s")
def lod_alt_ref(spark, sf):
    h, r, a = F.col("hist"), F.col("ref"), F.col("alt")
    loci = L.alternatives(histograms(spark, sf)).filter(L.count_of(h, a) > 0).withColumn("f", L.allele_fraction(h, r, a))
    out = L.lods(loci, ["tid", "p"], {"lod": F.col("f"), "lod_tenth": F.lit(0.1)})
    return out.select("tid", "p", "alt", F.round("lod", 6).alias("lod"), F.round("lod_tenth", 6).alias("lod_tenth"))


GENO = """, g(g, i) AS (VALUES ('AA', 0), ('AC', 1), ('CC', 2), ('AG', 3), ('CG', 4), ('GG', 5), ('AT', 6), ('CT', 7), ('GT', 8), ('TT', 9)),
  lk AS (SELECT tid, p, pile.ref, i, g, sum(log10(
     (CASE WHEN g[1] <> g[2] AND pile.ref = g[1] THEN 0.8 WHEN g[1] <> g[2] AND pile.ref = g[2] THEN 0.2 ELSE 0.5 END) * (CASE WHEN base = g[1] THEN 1 - e ELSE e / 3 END) +
     (CASE WHEN g[1] <> g[2] AND pile.ref = g[1] THEN 0.2 WHEN g[1] <> g[2] AND pile.ref = g[2] THEN 0.8 ELSE 0.5 END) * (CASE WHEN base = g[2] THEN 1 - e ELSE e / 3 END))) AS l
   FROM (SELECT *, pow(10, -quality / 10.0) AS e FROM pile WHERE quality >= 5) pile, g GROUP BY ALL)"""


def likelihoods(spark, sf):
    h = P.quality_histogram(V.pile(placed(spark, sf).filter((F.col("mapq") > 0) & (F.col("quality") >= 5))), also=["ref"])
    return h.withColumn("lk", L.genotype_likelihoods(F.col("hist"), F.col("ref"), F.lit(0.2)))


@query(WT + GENO + " SELECT tid, p, i, round(l, 5) AS l FROM lk")
def genotype_likelihoods(spark, sf):
    return likelihoods(spark, sf).select("tid", "p", F.posexplode("lk").alias("i", "x")).select("tid", "p", "i", F.round("x", 5).alias("l"))


@query(WT + GENO + ", r AS (SELECT *, row_number() OVER (PARTITION BY tid, p ORDER BY round(l, 9) DESC, i DESC) AS k FROM lk) SELECT tid, p, g AS genotype FROM r WHERE k = 1")
def best_genotype(spark, sf):
    return likelihoods(spark, sf).select("tid", "p", L.best_genotype(F.transform("lk", lambda x: F.round(x, 9))).alias("genotype"))


@query(WT + GENO + """, t AS (SELECT tid, p, max(ref) AS ref, substr('ACGT', CAST(1 + (tid * 7 + p * 3 + 1) % 4 AS INT), 1) AS alt, map_from_entries(list((g, l))) AS m FROM lk GROUP BY tid, p),
  v AS (SELECT tid, p, alt, m[ref || ref] AS rr, m[least(ref, alt) || greatest(ref, alt)] AS ra, m[alt || alt] AS aa FROM t),
  w AS (SELECT *, greatest(ra, aa) + ln(1 + pow(10, least(ra, aa) - greatest(ra, aa))) AS x FROM v)
  SELECT tid, p, round(rr - x, 5) AS ref_alt, round(x - rr, 5) AS alt_ref, round(ra - rr, 5) AS het_ref FROM w""")
def ref_vs_alt(spark, sf):
    lk = likelihoods(spark, sf).withColumn("alt", V.ref_base(F.col("tid"), F.col("p"), 1))
    a = (F.col("lk"), F.col("ref"), F.col("alt"))
    return lk.select("tid", "p", F.round(L.ref_versus_alt(*a), 5).alias("ref_alt"), F.round(L.alt_versus_ref(*a), 5).alias("alt_ref"), F.round(L.het_versus_ref(*a), 5).alias("het_ref"))


@query(WT + COUNTS + """, k AS (SELECT pile.*, alt, f, floor((count(*) OVER (PARTITION BY tid, p)) * 0.15) AS room, row_number() OVER (PARTITION BY tid, p, base = alt ORDER BY quality DESC) AS rn FROM pile JOIN fr USING (tid, p) WHERE n_alt > 0),
  c2 AS (SELECT tid, p, ref, alt, least(0.15, f) AS f, CASE WHEN base = alt AND rn > room THEN ref ELSE base END AS b, pow(10, -quality / 10.0) AS e FROM k)
  SELECT tid, p, alt, round(sum(log10((1 - f) * (CASE WHEN b = ref THEN 1 - e ELSE e / 3 END) + f * (CASE WHEN b = alt THEN 1 - e ELSE e / 3 END))) - sum(log10(CASE WHEN b = ref THEN 1 - e ELSE e / 3 END)), 5) AS contaminant_lod FROM c2 GROUP BY tid, p, alt""")
def contaminant_lod(spark, sf):
    h, r, a = F.col("hist"), F.col("ref"), F.col("alt")
    loci = L.alternatives(histograms(spark, sf)).filter(L.count_of(h, a) > 0)
    return L.contaminant_lods(loci, ["tid", "p"], 0.15, L.allele_fraction(h, r, a)).select("tid", "p", "alt", F.round("contaminant_lod", 5).alias("contaminant_lod"))


@query(WT + " SELECT DISTINCT depth, k, round((depth - k) * log10(f * 0.001 + (1 - f) * 0.999) + k * log10(f * 0.999 + (1 - f) * 0.001), 6) AS ll FROM (SELECT DISTINCT count(*) AS depth, count(*) FILTER (WHERE base <> ref) AS k, 0.3 AS f FROM pile GROUP BY tid, p)")
def power_log_likelihood(spark, sf):
    d = tumor_pile(spark, sf).groupBy("tid", "p").agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("base") != F.col("ref")).alias("k")).select("depth", "k").distinct()
    e, f = 0.001, 0.3
    return d.select("depth", "k", F.round((F.col("depth") - F.col("k")) * F.log10(F.lit(f * e + (1 - f) * (1 - e))) + F.col("k") * F.log10(F.lit(f * (1 - e) + (1 - f) * e)), 6).alias("ll"))


DEPTHS = WT + ", d AS (SELECT DISTINCT count(*) AS depth FROM pile GROUP BY tid, p)"
PMF = "exp(lgamma(depth + 1) - lgamma(k + 1) - lgamma(depth - k + 1) + k * ln({p}) + (depth - k) * ln(1 - {p}))"


def depths(spark, sf):
    r = placed(spark, sf).filter(F.col("mapq") > 0)
    spans = r.select("tid", F.col("pos").alias("start"), (F.col("pos") + F.col("len") - 1).alias("stop"))
    return P.depth_by_boundaries(spans).select("depth").distinct()


@query(DEPTHS + ", x AS (SELECT depth, CAST(unnest(generate_series(0, depth)) AS INT) AS k FROM d) SELECT depth, k, round(" + PMF.format(p="0.31") + ", 7) AS pmf FROM x")
def binomial_pmf(spark, sf):
    import pandas as pd

    from ..operators.power import binomial

    def run(batches):
        for b in batches:
            for n in b["depth"]:
                p = binomial(int(n), 0.31)
                yield pd.DataFrame({"depth": int(n), "k": range(len(p)), "pmf": p})

    return depths(spark, sf).mapInPandas(run, "depth bigint, k int, pmf double").select("depth", "k", F.round("pmf", 7).alias("pmf"))


def power_sql(p: str, lod: str, threshold: float, flip: bool) -> str:
    k = "depth - i" if flip else "i"
    return DEPTHS + f""", x AS (SELECT depth, i, {k} AS k FROM (SELECT depth, unnest(generate_series(0, depth)) AS i FROM d)),
      y AS (SELECT *, {PMF.format(p=p)} AS pr, {lod} AS lod FROM x), m AS (SELECT depth, min(i) AS t FROM y WHERE lod >= {threshold!r} GROUP BY depth),
      z AS (SELECT y.depth, sum(CASE WHEN i >= t THEN pr ELSE 0 END) AS s, max(CASE WHEN i = t - 1 THEN lod END) AS lb, max(CASE WHEN i = t THEN lod END) AS la, max(CASE WHEN i = t - 1 THEN pr END) AS pb FROM y JOIN m USING (depth) GROUP BY y.depth)
      SELECT depth, round(coalesce(s + coalesce((1 - ({threshold!r} - lb) / (la - lb)) * pb, 0), 0), 6) AS power FROM d LEFT JOIN z USING (depth)"""


CFG = SomaticConfig()
PP = repr(CFG.power_af * (1 - CFG.eps) + (1 - CFG.power_af) * CFG.eps)
LODT = f"((depth - k) * log10((k / depth) * {CFG.eps!r} + (1 - k / depth) * {1 - CFG.eps!r}) + (CASE WHEN k = 0 THEN 0 ELSE k * log10((k / depth) * {1 - CFG.eps!r} + (1 - k / depth) * {CFG.eps!r}) END)) - ((depth - k) * log10({1 - CFG.eps!r}) + k * log10({CFG.eps!r}))"
LODN = f"((depth - k) * log10({1 - CFG.eps!r}) + k * log10({CFG.eps!r})) - (depth * log10(0.5))"


@query(power_sql(PP, LODT, CFG.tumor_lod, False))
def tumor_power(spark, sf):
    out = with_power(depths(spark, sf), "tumor", "depth", "power", CFG.eps, CFG.tumor_lod, CFG.power_af)
    return out.select("depth", F.round("power", 6).alias("power"))


@query(power_sql(repr(CFG.eps), LODN, CFG.normal_lod, True))
def normal_power(spark, sf):
    out = with_power(depths(spark, sf), "normal", "depth", "power", CFG.eps, CFG.normal_lod)
    return out.select("depth", F.round("power", 6).alias("power"))


@query(WT + """, o AS (SELECT tid, p, abs(p - pos) AS x FROM pile WHERE base <> ref), m AS (SELECT tid, p, median(x) AS m FROM o GROUP BY tid, p)
  SELECT tid, p, max(m) AS median, median(abs(x - m)) AS mad FROM o JOIN m USING (tid, p) GROUP BY tid, p""")
def offset_median_mad(spark, sf):
    o = V.mismatches(placed(spark, sf).filter(F.col("mapq") > 0), "pos").groupBy("tid", "p", F.abs(F.col("p") - F.col("pos")).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    o = o.groupBy("tid", "p").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("x")).withColumn("median", S.weighted_median(F.col("x")))
    return o.select("tid", "p", "median", S.weighted_median(S.deviations(F.col("x"), F.col("median"))).alias("mad"))


@query(W + " SELECT tid, CAST(floor(pos / 100) AS INT) AS chunk, count(*) AS n FROM reads GROUP BY tid, floor(pos / 100)")
def chunk_histogram(spark, sf):
    return V.reads(spark, sf).groupBy("tid", F.floor(F.col("pos") / 100).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query(W + " SELECT tid, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM reads GROUP BY tid")
def index_statistics(spark, sf):
    gone = R.has(F.col("flag"), R.UNMAPPED)
    return V.reads(spark, sf).groupBy("tid").agg(F.count_if(~gone).alias("mapped"), F.count_if(gone).alias("unmapped"))


@query(W + " SELECT qid, partkey, tid, pos, len FROM reads WHERE tid = 2 AND pos < 700 AND pos + len - 1 >= 500")
def region_scan(spark, sf):
    from ..sources.sam import region

    r = V.reads(spark, sf).withColumn("stop", F.col("pos") + F.col("len") - 1)
    return region(r, 2, 500, 700).select("qid", "partkey", "tid", "pos", "len")


@query(W + ", q(t, b, e) AS (VALUES (1, 100, 200), (1, 150, 300), (4, 0, 90)) SELECT tid, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM q JOIN reads ON tid = t AND pos < e AND pos + len - 1 >= b GROUP BY tid")
def multi_region_scan(spark, sf):
    from ..sources.sam import regions

    r = V.reads(spark, sf).withColumn("stop", F.col("pos") + F.col("len") - 1)
    return regions(r, [(1, 100, 200), (1, 150, 300), (4, 0, 90)]).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query(W + " SELECT quality, count(*) AS n, CAST(CASE WHEN quality > 31 THEN quality - 31 ELSE 0 END AS INT) AS shifted FROM reads GROUP BY quality")
def qual_shift(spark, sf):
    return V.reads(spark, sf).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).withColumn("shifted", B.shift_illumina13(F.col("quality")))


@query(WP + ", c AS (SELECT tid, p, count(*) FILTER (WHERE base <> ref) / count(*) AS x FROM pile GROUP BY tid, p) SELECT tid, p, round(CASE WHEN x <= 0 THEN 99 ELSE least(99, -4.3429 * ln(x)) END, 6) + 0.0 AS phred FROM c")
def phred_score(spark, sf):
    c = pile(spark, sf).groupBy("tid", "p").agg((F.count_if(F.col("base") != F.col("ref")) / F.count(F.lit(1))).alias("x"))
    return c.select("tid", "p", F.round(B.phred(F.col("x")), 6).alias("phred"))


@query(WP + """ SELECT base, ref, CASE WHEN base = ref THEN base WHEN base || ref IN ('AC', 'CA') THEN 'M' WHEN base || ref IN ('AG', 'GA') THEN 'R' WHEN base || ref IN ('AT', 'TA') THEN 'W' WHEN base || ref IN ('CG', 'GC') THEN 'S' WHEN base || ref IN ('CT', 'TC') THEN 'Y' ELSE 'K' END AS code,
  CAST(CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END AS INT) AS base_index, count(*) AS n FROM pile GROUP BY ALL""")
def iupac(spark, sf):
    n = pile(spark, sf).groupBy("base", "ref").agg(F.count(F.lit(1)).alias("n"))
    return n.select("base", "ref", B.iupac(F.col("base"), F.col("ref")).alias("code"), B.base_index(F.col("base")).alias("base_index"), "n")
