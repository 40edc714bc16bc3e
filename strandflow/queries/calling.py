"""Queries of the two callers and of bias statistics; SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import GermlineConfig, SomaticConfig
from ..operators import bias, downsample, indel
from ..operators import pileup as P
from ..plans import alignment_view as V
from ..plans import germline, somatic
from .pileup import W, WP, folded, pile, placed
from .tables import marks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def somatic_pile(spark, sf):
    rows = folded(spark, sf, F.col("sample") == "NORMAL")
    return rows.withColumns({"fwd_offset": F.abs(F.col("p") - F.col("pos")), "rev_offset": F.abs(F.col("p") - F.col("pos") - F.col("len") + 1), "gap": F.when((F.col("partkey") % 97 == 0) & (F.abs(F.col("p") - F.col("pos")) <= 5), "I"), "clean": F.col("partkey") % 29 != 0})


def annotations(spark, sf):
    m = marks(spark, sf).select("tid", "p", "cosmic").distinct()
    return m.filter("not cosmic").select("tid", "p"), m.filter("cosmic").select("tid", "p")


SOM = """, {fold}, x AS (SELECT tid, p, r.base AS base, r.ref AS ref, r.quality AS quality, r.mapq AS mapq, r.rev AS rev, r.sample AS sample, r.o2 AS partkey, p - r.o0 AS fo, pow(10, -r.quality / 10.0) AS e FROM f WHERE r IS NOT NULL),
  s AS (SELECT tid, p, ref, substr('ACGT', CAST(1 + (tid * 7 + p * 3 + 1) % 4 AS INT), 1) AS alt,
    count(*) FILTER (WHERE sample = 'TUMOR' AND quality >= 5 AND mapq > 0) AS t_depth, count(*) FILTER (WHERE sample = 'NORMAL' AND quality >= 5 AND mapq > 0) AS n_depth,
    count(*) FILTER (WHERE quality >= 5 AND mapq = 0) AS mq0, count(*) FILTER (WHERE quality >= 5) AS reads,
    count(*) FILTER (WHERE sample = 'TUMOR' AND partkey % 97 = 0 AND fo <= 5) AS t_ins,
    count(*) FILTER (WHERE sample = 'TUMOR' AND quality >= 5 AND mapq > 0 AND base <> ref) AS t_alt0, count(*) FILTER (WHERE sample = 'TUMOR' AND quality > 13 AND mapq > 0 AND base <> ref) AS t_sum_alt,
    count(*) FILTER (WHERE sample = 'NORMAL' AND quality >= 5 AND base <> ref) AS n_alt, CAST(coalesce(sum(quality) FILTER (WHERE sample = 'NORMAL' AND quality >= 5 AND base <> ref), 0) AS BIGINT) AS n_alt_sum FROM x GROUP BY tid, p, ref)
  SELECT tid, p, ref, t_depth, n_depth, mq0, reads, t_ins, n_alt, n_alt_sum FROM s""".replace("{fold}", "f AS (SELECT tid, p, unnest(CASE WHEN len(l) = 1 THEN l ELSE [list_reduce(l, lambda a, x: CASE WHEN a IS NULL THEN x WHEN a.base <> x.base THEN CASE WHEN x.sample = 'NORMAL' THEN CASE WHEN x.base <> x.ref THEN x ELSE a END ELSE NULL END WHEN a.quality < x.quality THEN x ELSE a END)] END) AS r FROM (SELECT tid, p, qid, list({'o0': pos, 'o1': qid, 'o2': partkey, 'o3': suppkey, 'o4': price, 'base': base, 'ref': ref, 'quality': quality, 'mapq': mapq, 'rev': rev, 'sample': sample} ORDER BY pos, qid, partkey, suppkey, price) AS l FROM pile GROUP BY tid, p, qid))")


@query(WP + SOM)
def somatic_site_counts(spark, sf):
    from ..operators.likelihood import count_of
    from ..plans.alignment_view import ref_base

    s = somatic.loci(somatic_pile(spark, sf), SomaticConfig())
    alt = ref_base(F.col("tid"), F.col("p"), 1)
    return s.select("tid", "p", "ref", "t_depth", "n_depth", "mq0", "reads", "t_ins", count_of(F.col("n_used"), alt).alias("n_alt"), somatic._quality_sum(F.col("n_used"), alt).alias("n_alt_sum"))


def _tail_sql(name: str, pairs: str, p: str, lod: str, threshold: float, flip: bool = False) -> str:
    """CTEs of the power of each (depth, f) of ``pairs``: what is reached from the first count on, the one before it in part."""
    k = "depth - i" if flip else "i"
    pmf = f"exp(lgamma(depth + 1) - lgamma(k + 1) - lgamma(depth - k + 1) + k * ln({p}) + (depth - k) * ln(1 - {p}))"
    return f"""{name}_d AS ({pairs}), {name}_x AS (SELECT depth, f, i, {k} AS k FROM (SELECT depth, f, unnest(generate_series(0, depth)) AS i FROM {name}_d WHERE depth > 0)),
      {name}_y AS (SELECT *, {pmf} AS pr, {lod} AS lod FROM {name}_x), {name}_m AS (SELECT depth, f, min(i) AS t FROM {name}_y WHERE lod >= {threshold!r} GROUP BY ALL),
      {name}_z AS (SELECT depth, f, sum(CASE WHEN i >= t THEN pr ELSE 0 END) AS s, max(CASE WHEN i = t - 1 THEN lod END) AS lb, max(CASE WHEN i = t THEN lod END) AS la, max(CASE WHEN i = t - 1 THEN pr END) AS pb FROM {name}_y JOIN {name}_m USING (depth, f) GROUP BY depth, f),
      {name} AS (SELECT depth, f, s + coalesce((1 - ({threshold!r} - lb) / (la - lb)) * pb, 0) AS power FROM {name}_z)"""


def _somatic_sql(final: str) -> str:
    """The caller in SQL over the alignment view, in which a locus has one other letter."""
    c = SomaticConfig()
    e = c.eps
    right, wrong = "(CASE WHEN base = ref THEN 1 - e ELSE e / 3 END)", "(CASE WHEN base = alt THEN 1 - e ELSE e / 3 END)"
    ll = lambda f: f"log10((1 - {f}) * {right} + {f} * {wrong})"
    mixed = lambda f: f"log10((1 - {f}) * (CASE WHEN b = ref THEN 1 - e ELSE e / 3 END) + {f} * (CASE WHEN b = alt THEN 1 - e ELSE e / 3 END))"
    share = lambda a, r: f"CASE WHEN {a} + {r} = 0 THEN 0 ELSE {a} / ({a} + {r}) END"
    lod_t = f"((depth - k) * log10((k / depth) * {e!r} + (1 - k / depth) * {1 - e!r}) + (CASE WHEN k = 0 THEN 0 ELSE k * log10((k / depth) * {1 - e!r} + (1 - k / depth) * {e!r}) END)) - ((depth - k) * log10({1 - e!r}) + k * log10({e!r}))"
    lod_n = f"((depth - k) * log10({1 - e!r}) + k * log10({e!r})) - (depth * log10(0.5))"
    own, flat = f"(f * {1 - e!r} + (1 - f) * {e!r})", repr(c.power_af * (1 - e) + (1 - c.power_af) * e)
    reasons = [
        ("fstar_tumor_lod", f"t_lod < {c.tumor_lod!r}"),
        ("nearby_gap_events", f"t_ins >= {c.gap_events_threshold}"),
        ("possible_contamination", f"t_lod <= {c.tumor_lod!r} + greatest(0, contaminant_lod)"),
        ("germline_risk", f"at_risk AND init_n_lod < {c.normal_dbsnp_lod!r}"),
        ("normal_lod", f"init_n_lod < {c.normal_lod!r}"),
        ("alt_allele_in_normal", f"(n_alt >= {c.max_alt_in_normal_count} OR normal_f >= {c.max_alt_in_normal_fraction!r}) AND n_alt_sum > {c.max_alt_in_normal_qsum}"),
        ("clustered_read_position", f"(coalesce(fm, 99) <= {c.pir_median_threshold!r} AND fd <= {c.pir_mad_threshold!r}) OR (coalesce(rm, 99) <= {c.pir_median_threshold!r} AND rd <= {c.pir_mad_threshold!r})"),
        ("strand_artifact", f"(coalesce(power_neg, 0) >= {c.strand_artifact_power!r} AND t_lod_fwd < {c.strand_artifact_lod!r}) OR (coalesce(power_pos, 0) >= {c.strand_artifact_power!r} AND t_lod_rev < {c.strand_artifact_lod!r})"),
        ("poor_mapping_region_mapq0", f"reads > 0 AND CAST(CAST(mq0 AS FLOAT) / CAST(reads AS FLOAT) AS DOUBLE) >= {c.fraction_mapq0_threshold!r}"),
        ("poor_mapping_region_alternate_allele_mapq", f"coalesce(alt_mapq, 0) < {c.required_max_alt_mapq}"),
    ]
    said = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in reasons) + "], lambda x: x IS NOT NULL)"
    fraction = repr(max(c.minimum_mutation_cell_fraction, c.fraction_contamination))
    return WP + f""", g AS (SELECT tid, p, qid, list({{'o0': pos, 'o1': qid, 'o2': partkey, 'o3': suppkey, 'o4': price, 'base': base, 'ref': ref, 'quality': quality, 'mapq': mapq, 'rev': rev, 'sample': sample, 'len': len}} ORDER BY pos, qid, partkey, suppkey, price) AS l FROM pile GROUP BY tid, p, qid),
      f0 AS (SELECT tid, p, unnest(CASE WHEN len(l) = 1 THEN l ELSE [list_reduce(l, lambda a, x: CASE WHEN a IS NULL THEN x WHEN a.base <> x.base THEN CASE WHEN x.sample = 'NORMAL' THEN CASE WHEN x.base <> x.ref THEN x ELSE a END ELSE NULL END WHEN a.quality < x.quality THEN x ELSE a END)] END) AS r FROM g),
      x AS (SELECT tid, p, r.base AS base, r.ref AS ref, substr('ACGT', CAST(1 + (tid * 7 + p * 3 + 1) % 4 AS INT), 1) AS alt, r.quality AS q, r.mapq AS mapq, r.rev AS rev, r.o2 AS partkey, abs(p - r.o0) AS fo, abs(p - r.o0 - r.len + 1) AS ro, pow(10, -r.quality / 10.0) AS e,
        r.sample = 'TUMOR' AS tu, r.quality >= {c.min_qscore} AS us, r.quality >= {c.min_qscore} AND r.mapq > 0 AS tp, r.sample = 'TUMOR' AND r.quality >= {c.min_qscore} AND r.mapq > 0 AND r.o2 % 29 <> 0 AS pk FROM f0 WHERE r IS NOT NULL),
      s AS (SELECT tid, p, ref, alt, count(*) FILTER (WHERE tu AND tp AND base = ref) AS f_ref, count(*) FILTER (WHERE tu AND tp AND base = alt) AS f_alt, count(*) FILTER (WHERE pk AND base = ref) AS c_ref, count(*) FILTER (WHERE pk AND base = alt) AS c_alt,
        count(*) FILTER (WHERE pk AND NOT rev AND base = ref) AS w_ref, count(*) FILTER (WHERE pk AND NOT rev AND base = alt) AS w_alt, count(*) FILTER (WHERE pk AND rev AND base = ref) AS v_ref, count(*) FILTER (WHERE pk AND rev AND base = alt) AS v_alt,
        count(*) FILTER (WHERE NOT tu AND us AND base = ref) AS n_ref, count(*) FILTER (WHERE NOT tu AND us AND base = alt) AS n_alt, coalesce(sum(q) FILTER (WHERE NOT tu AND us AND base = alt), 0) AS n_alt_sum, count(*) FILTER (WHERE tu AND tp AND q > {c.min_qsum_qscore} AND base = alt) AS sums,
        count(*) FILTER (WHERE tu AND tp) AS t_depth, count(*) FILTER (WHERE NOT tu AND tp) AS n_depth, count(*) FILTER (WHERE us AND mapq = 0) AS mq0, count(*) FILTER (WHERE us) AS reads, count(*) FILTER (WHERE tu AND partkey % 97 = 0 AND fo <= 5) AS t_ins,
        max(mapq) FILTER (WHERE pk AND base = alt) AS alt_mapq, count(*) FILTER (WHERE pk) AS picked, count(*) FILTER (WHERE pk AND NOT rev) AS fwd_depth, count(*) FILTER (WHERE pk AND rev) AS rev_depth, median(fo) FILTER (WHERE pk AND base = alt) AS fm, median(ro) FILTER (WHERE pk AND base = alt) AS rm,
        count(*) FILTER (WHERE tu AND tp AND q >= 20) AS t_q20, count(*) FILTER (WHERE NOT tu AND tp AND q >= 20) AS n_q20, coalesce(sum(q) FILTER (WHERE pk AND base = ref), 0) AS c_ref_sum, coalesce(sum(q) FILTER (WHERE pk AND base = alt), 0) AS c_alt_sum,
        coalesce(sum(q) FILTER (WHERE NOT tu AND us AND base = ref), 0) AS n_ref_sum, max(mapq) FILTER (WHERE pk AND base = ref) AS ref_mapq FROM x GROUP BY tid, p, ref, alt),
      h AS (SELECT *, {share("f_alt", "f_ref")} AS ff, {share("c_alt", "c_ref")} AS tf, {share("w_alt", "w_ref")} AS wf, {share("v_alt", "v_ref")} AS vf, {share("n_alt", "n_ref")} AS normal_f FROM s WHERE sums > 0 AND picked > 0),
      rk AS (SELECT x.*, row_number() OVER (PARTITION BY x.tid, x.p, tu AND tp, base = x.alt ORDER BY q DESC) AS rn FROM x JOIN h USING (tid, p)),
      j AS (SELECT rk.*, ff, tf, wf, vf, fm, rm, CASE WHEN base = rk.alt AND rn > floor(t_depth * {fraction}) THEN rk.ref ELSE base END AS b, least({fraction}, ff) AS cf FROM rk JOIN h USING (tid, p)),
      y AS (SELECT tid, p, sum({ll("ff")} - {ll("0")}) FILTER (WHERE tu AND tp) AS lod0, coalesce(sum({ll("tf")} - {ll("0")}) FILTER (WHERE pk), 0) AS t_lod, coalesce(sum({ll("wf")} - {ll("0")}) FILTER (WHERE pk AND NOT rev), 0) AS t_lod_fwd, coalesce(sum({ll("vf")} - {ll("0")}) FILTER (WHERE pk AND rev), 0) AS t_lod_rev,
        sum({mixed("cf")} - {mixed("0")}) FILTER (WHERE tu AND tp) AS contaminant_lod, coalesce(sum({ll("0")}) FILTER (WHERE NOT tu AND us), 0) AS rr, coalesce(sum({ll("0.5")}) FILTER (WHERE NOT tu AND us), 0) AS ra, coalesce(sum({ll("1")}) FILTER (WHERE NOT tu AND us), 0) AS aa,
        sum({ll("0")}) FILTER (WHERE pk) AS t_rr, sum({ll("0.5")}) FILTER (WHERE pk) AS t_ra, sum({ll("1")}) FILTER (WHERE pk) AS t_aa,
        median(abs(fo - fm)) FILTER (WHERE pk AND base = alt) AS fd, median(abs(ro - rm)) FILTER (WHERE pk AND base = alt) AS rd FROM j GROUP BY tid, p),
      mk AS (SELECT CAST(o_orderkey % 7 AS INT) AS tid, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS p, bool_or(o_orderpriority NOT LIKE '1%') AS dbsnp, bool_or(o_orderpriority LIKE '1%') AS cosmic FROM orders GROUP BY 1, 2),
      k AS (SELECT h.*, y.* EXCLUDE (tid, p), rr - (greatest(ra, aa) + ln(1 + pow(10, least(ra, aa) - greatest(ra, aa)))) AS init_n_lod, greatest(t_ra, t_aa) + ln(1 + pow(10, least(t_ra, t_aa) - greatest(t_ra, t_aa))) - t_rr AS init_t_lod, coalesce(dbsnp, false) AS db, coalesce(cosmic, false) AS co, coalesce(dbsnp AND NOT cosmic, false) AS at_risk FROM h JOIN y USING (tid, p) LEFT JOIN mk USING (tid, p) WHERE ff >= {c.tumor_f_pretest!r} AND lod0 >= {c.initial_tumor_lod!r}),
      {_tail_sql("ps", "SELECT DISTINCT fwd_depth AS depth, tf AS f FROM k UNION SELECT DISTINCT rev_depth, tf FROM k", own, lod_t, c.strand_artifact_lod)},
      {_tail_sql("pt", "SELECT DISTINCT t_depth AS depth, 0 AS f FROM k", flat, lod_t, c.tumor_lod)},
      {_tail_sql("pn", "SELECT DISTINCT n_depth AS depth, 0 AS f FROM k", repr(e), lod_n, c.normal_lod, True)},
      {_tail_sql("pw", "SELECT DISTINCT n_depth AS depth, 0 AS f FROM k", repr(e), lod_n, c.normal_dbsnp_lod, True)},
      n AS (SELECT k.*, a.power AS power_neg, b.power AS power_pos, coalesce(pt.power, 0) AS tumor_power, coalesce(pn.power, 0) AS nsp, coalesce(pw.power, 0) AS wsp, coalesce(pt.power, 0) * coalesce(CASE WHEN at_risk THEN pw.power ELSE pn.power END, 0) AS power, t_depth >= {c.tumor_covered_depth} AND n_depth >= (CASE WHEN at_risk THEN {c.normal_covered_depth_dbsnp} ELSE {c.normal_covered_depth} END) AS covered
        FROM k LEFT JOIN ps a ON a.depth = fwd_depth AND a.f = tf LEFT JOIN ps b ON b.depth = rev_depth AND b.f = tf LEFT JOIN pt ON pt.depth = t_depth LEFT JOIN pn ON pn.depth = n_depth LEFT JOIN pw ON pw.depth = n_depth),
      o AS (SELECT *, {said} AS reasons FROM n) {final}"""


@query(_somatic_sql("SELECT tid, p, ref, alt, round(tf, 6) AS tumor_f, round(t_lod, 5) AS t_lod, round(init_n_lod, 5) AS init_n_lod, round(contaminant_lod, 5) AS contaminant_lod, array_to_string(reasons, ',') AS reasons FROM o"))
def somatic_candidates(spark, sf):
    cfg = SomaticConfig()
    c = somatic.candidates(somatic.loci(somatic_pile(spark, sf), cfg), cfg, *annotations(spark, sf))
    return c.select("tid", "p", "ref", "alt", F.round("tumor_f", 6).alias("tumor_f"), F.round("t_lod", 5).alias("t_lod"), F.round("init_n_lod", 5).alias("init_n_lod"), F.round("contaminant_lod", 5).alias("contaminant_lod"), F.array_join("reasons", ",").alias("reasons"))


@query(_somatic_sql("SELECT tid, p, ref, alt, round(power, 6) AS power, covered, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'KEEP' ELSE 'REJECT' END AS judgement FROM o"))
def somatic_calls(spark, sf):
    out = somatic.call(somatic_pile(spark, sf), SomaticConfig(), *annotations(spark, sf))
    return out.select("tid", "p", "ref", "alt", F.round("power", 6).alias("power"), "covered", F.array_join("reasons", ",").alias("reasons"), "judgement")


def _somatic_text_sql() -> str:
    three = lambda x: f"CASE WHEN {x} < 0.0005 THEN '0' ELSE regexp_replace(printf('%.3f', CAST({x} AS DOUBLE)), '\\.?0+$', '') END"
    keep = "len(reasons) = 0"
    normal = f"'0:' || n_ref || ',' || n_alt || ':.:' || (n_ref + n_alt) || ':' || {three('normal_f')} || CASE WHEN {keep} THEN ':0' ELSE '' END"
    tumor = f"'0/1:' || c_ref || ',' || c_alt || ':' || CASE WHEN c_alt > 0 THEN CAST(CAST(round(c_alt_sum / c_alt, 0) AS INT) AS VARCHAR) ELSE '.' END || ':' || (c_ref + c_alt) || ':' || {three('tf')} || CASE WHEN {keep} THEN ':2' ELSE '' END"
    info = f"array_to_string(list_filter([CASE WHEN db THEN 'DB' END, CASE WHEN {keep} THEN 'SOMATIC' END, CASE WHEN {keep} THEN 'VT=SNP' END], lambda x: x IS NOT NULL), ';')"
    fields = ["'c' || tid", "(p + 1)", "'.'", "ref", "alt", "'.'", f"CASE WHEN {keep} THEN 'PASS' ELSE 'REJECT' END", f"CASE WHEN {info} = '' THEN '.' ELSE {info} END", f"'GT:AD:BQ:DP:FA' || CASE WHEN {keep} THEN ':SS' ELSE '' END", normal, tumor]
    return _somatic_sql("SELECT tid, p, " + " || chr(9) || ".join(fields) + " AS line FROM o")


@query(_somatic_text_sql())
def somatic_records(spark, sf):
    from ..sinks.calls import somatic_vcf

    out = somatic.call(somatic_pile(spark, sf), SomaticConfig(), *annotations(spark, sf))
    contigs = spark.range(7).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("c"), "id").alias("contig"))
    return somatic_vcf(out, contigs)


def _call_stats_sql() -> str:
    number = lambda x: f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN abs({x}) < 5e-7 THEN '0' ELSE regexp_replace(printf('%.6f', CAST({x} AS DOUBLE)), '\\.?0+$', '') END"
    ref = lambda k: f"substr('ACGT', CAST(1 + (tid * 7 + (p + {k + 4}) * 3) % 4 AS INT), 1)"
    plain = {
        "contig": "CAST(tid AS VARCHAR)", "position": "CAST(p + 1 AS VARCHAR)", "context": " || ".join([*map(ref, (-3, -2, -1)), "'x'", *map(ref, (1, 2, 3))]), "ref_allele": "ref", "alt_allele": "alt", "tumor_name": "'TUMOR'", "normal_name": "'NORMAL'", "score": "'0'",
        "dbsnp_site": "CASE WHEN db AND co THEN 'DBSNP+COSMIC' WHEN db THEN 'DBSNP' WHEN co THEN 'COSMIC' ELSE 'NOVEL' END", "covered": "CASE WHEN covered THEN 'COVERED' ELSE 'UNCOVERED' END", "contaminant_fraction": "'0.02'", "normal_best_gt": "gt",
        "strand_bias_counts": "'(' || w_ref || ',' || v_ref || ',' || w_alt || ',' || v_alt || ')'", "observed_in_normals_count": "'0'", "failure_reasons": "array_to_string(reasons, ',')", "judgement": "CASE WHEN len(reasons) = 0 THEN 'KEEP' ELSE 'REJECT' END",
    }
    numbers = {
        "power": "power", "tumor_power": "tumor_power", "normal_power": "CASE WHEN at_risk THEN wsp ELSE nsp END", "normal_power_nsp": "nsp", "normal_power_wsp": "wsp", "total_reads": "reads", "map_Q0_reads": "mq0", "init_t_lod": "init_t_lod", "t_lod_fstar": "t_lod", "t_lod_fstar_forward": "t_lod_fwd", "t_lod_fstar_reverse": "t_lod_rev",
        "tumor_f": "tf", "contaminant_lod": "contaminant_lod", "t_q20_count": "t_q20", "t_ref_count": "c_ref", "t_alt_count": "c_alt", "t_ref_sum": "c_ref_sum", "t_alt_sum": "c_alt_sum", "t_ref_max_mapq": "coalesce(ref_mapq, 0)", "t_alt_max_mapq": "coalesce(alt_mapq, 0)", "t_ins_count": "t_ins", "t_del_count": "0",
        "init_n_lod": "init_n_lod", "normal_f": "normal_f", "n_q20_count": "n_q20", "n_ref_count": "n_ref", "n_alt_count": "n_alt", "n_ref_sum": "n_ref_sum", "n_alt_sum": "n_alt_sum", "power_to_detect_positive_strand_artifact": "coalesce(power_pos, 0)", "power_to_detect_negative_strand_artifact": "coalesce(power_neg, 0)",
        "tumor_alt_fpir_median": "fm", "tumor_alt_fpir_mad": "fd", "tumor_alt_rpir_median": "rm", "tumor_alt_rpir_mad": "rd",
    }
    cols = ", ".join([f"{v} AS {k}" for k, v in plain.items()] + [f"{number('(' + v + ')')} AS {k}" for k, v in numbers.items()])
    # the best of ten genotypes of the normal's bases; the last of equals
    best = """, gn(g, i) AS (VALUES ('AA', 0), ('AC', 1), ('CC', 2), ('AG', 3), ('CG', 4), ('GG', 5), ('AT', 6), ('CT', 7), ('GT', 8), ('TT', 9)),
      gl AS (SELECT tid, p, i, g, sum(log10(0.5 * (CASE WHEN base = g[1] THEN 1 - e ELSE e / 3 END) + 0.5 * (CASE WHEN base = g[2] THEN 1 - e ELSE e / 3 END))) AS l FROM x, gn WHERE NOT tu AND us GROUP BY ALL),
      gb AS (SELECT tid, p, arg_max(g, {'l': round(l, 9), 'i': i}) AS gt0 FROM gl GROUP BY tid, p), w AS (SELECT o.*, coalesce(gt0, 'TT') AS gt FROM o LEFT JOIN gb USING (tid, p))"""
    return _somatic_sql(f"{best} SELECT {cols} FROM w")


@query(_call_stats_sql())
def call_stats_rows(spark, sf):
    from ..plans.alignment_view import ref_base
    from ..sinks.calls import call_stats

    out = somatic.call(somatic_pile(spark, sf), SomaticConfig(), *annotations(spark, sf))
    near = [F.lit("x") if k == 0 else ref_base(F.col("tid"), F.col("p") + k + 4) for k in range(-3, 4)]
    return call_stats(out.withColumn("context", F.concat(*near)))


EQ = ", eqs AS (SELECT *, greatest(4, least(quality, least(mapq, 60), 63)) AS eq FROM pile WHERE quality >= 13)"


@query(WP + EQ + """, s AS (SELECT tid, p, ref, sample, sum(eq) AS t, sum(eq) FILTER (WHERE base = 'A') AS a, sum(eq) FILTER (WHERE base = 'C') AS c, sum(eq) FILTER (WHERE base = 'G') AS g, sum(eq) FILTER (WHERE base = 'T') AS x FROM eqs GROUP BY ALL)
  SELECT tid, p, round(sum(coalesce(a, 0) / t), 6) AS qs_a, round(sum(coalesce(c, 0) / t), 6) AS qs_c, round(sum(coalesce(g, 0) / t), 6) AS qs_g, round(sum(coalesce(x, 0) / t), 6) AS qs_t FROM s GROUP BY tid, p""")
def sample_qsum_combine(spark, sf):
    site = germline.combine(germline.samples(pile(spark, sf).filter("quality >= 13")))
    return site.select("tid", "p", *[F.round(F.col("qs")[i], 6).alias(f"qs_{b}") for i, b in enumerate("acgt")])


@query(WP + EQ + " SELECT tid, p, sample, count(*) AS n, CAST(sum(eq) AS BIGINT) AS q, count(*) FILTER (WHERE base = ref AND NOT rev) AS rf, count(*) FILTER (WHERE base = ref AND rev) AS rr, count(*) FILTER (WHERE base <> ref AND NOT rev) AS af, count(*) FILTER (WHERE base <> ref AND rev) AS ar FROM eqs GROUP BY tid, p, sample")
def sample_likelihood_sums(spark, sf):
    s = germline.samples(pile(spark, sf).filter("quality >= 13"))
    total = F.aggregate("qsum", F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("tid", "p", "sample", F.col("depth").alias("n"), total.alias("q"), *[F.col("anno")[i].alias(c) for i, c in enumerate(("rf", "rr", "af", "ar"))])


@query()
def germline_calls(spark, sf):
    c = germline.call(pile(spark, sf).filter(F.col("mapq") > 0), GermlineConfig())
    return c.select("tid", "p", "ref", F.array_join("alt", ",").alias("alt"), F.round("qual", 3).alias("qual"), "depth", "an", F.array_join(F.transform("ac", lambda x: x.cast("string")), ",").alias("ac"), F.array_join(F.transform("samples", lambda s: F.concat(s["sample"], F.lit(":"), s["gt"])), ",").alias("genotypes"))


@query()
def germline_records(spark, sf):
    """Variant text of the called sites, tags and all."""
    from ..sinks.calls import germline_vcf

    rows = pile(spark, sf).filter(F.col("mapq") > 0).withColumns({"read_pos": F.col("p") - F.col("pos") + 1, "read_len": F.col("len")})
    contigs = spark.range(7).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("c"), "id").alias("contig"))
    return germline_vcf(germline.with_tags(germline.call(rows, GermlineConfig()), rows), contigs)


@query(WP + """, h AS (SELECT tid, p, quality // 10 AS k, count(*) FILTER (WHERE base = ref) AS a, count(*) FILTER (WHERE base <> ref) AS b FROM pile GROUP BY ALL),
  u AS (SELECT tid, p, sum(a * (coalesce(nb, 0) + b * 0.5)) AS u, sum(a) AS n, sum(b) AS m FROM (SELECT *, sum(b) OVER (PARTITION BY tid, p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM h) GROUP BY tid, p)
  SELECT tid, p, round(exp(-0.5 * (u - n * m / 2.0) * (u - n * m / 2.0) / (n * m * (n + m + 1) / 12.0)), 6) AS mwu FROM u WHERE (n >= 8 OR m >= 8) AND n > 2 AND m > 2""")
def mwu_bias(spark, sf):
    same = F.col("base") == F.col("ref")
    per = pile(spark, sf).groupBy("tid", "p", F.floor(F.col("quality") / 10).cast("int").alias("k")).agg(F.count_if(same).alias("a"), F.count_if(~same).alias("b"))
    bins = lambda c: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(F.try_element_at(F.transform(F.filter("h", lambda x: x["k"] == i), lambda x: x[c]), F.lit(1)), F.lit(0).cast("long")))
    loci = per.groupBy("tid", "p").agg(F.collect_list(F.struct("k", "a", "b")).alias("h"), F.sum("a").alias("n"), F.sum("b").alias("m")).filter("(n >= 8 or m >= 8) and n > 2 and m > 2")
    loci = bias.with_statistic(loci.select("tid", "p", bins("a").alias("ha"), bins("b").alias("hb")), "mwu", bias.mann_whitney, "ha", "hb")
    return loci.select("tid", "p", F.round("mwu", 6).alias("mwu"))


@query()
def vdb(spark, sf):
    alt = pile(spark, sf).filter(F.col("base") != F.col("ref")).withColumn("k", F.floor((F.col("p") - F.col("pos") + 1) / (F.col("len") + 1) * 100).cast("int"))
    per = alt.groupBy("tid", "p", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("tid", "p").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("h"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.coalesce(F.try_element_at("h", i), F.lit(0).cast("long")))
    return per.select("tid", "p", F.round(bias.vdb_column(hist), 6).alias("vdb")).filter("vdb is not null")


SB = WP + """, s AS (SELECT tid, p, sample, count(*) AS d, count(*) FILTER (WHERE base <> ref) AS o FROM pile GROUP BY tid, p, sample),
  t AS (SELECT tid, p, count(*) AS n, sum(o) AS nr, floor(sum(d) / count(*)) AS ad FROM s GROUP BY tid, p),
  m AS (SELECT *, greatest(1, least(floor(nr / ad + 0.5), n)) AS m FROM t WHERE nr > 0), v AS (SELECT *, m / 2.0 / n AS f, nr / n AS pp, nr / m AS q FROM m)
  SELECT tid, p, round(sum(CASE WHEN o > 0 THEN ln(exp(ln(2 * (1 - f))) + exp(ln(f) + o * ln(2) - q)) + ln(f) + o * ln(q / pp) - q + pp ELSE ln(2 * f * (1 - f) * exp(-q) + f * f * exp(-2 * q) + (1 - f) * (1 - f)) + pp END), 5) AS seg_bias FROM s JOIN v USING (tid, p) GROUP BY tid, p"""


@query(SB)
def seg_bias(spark, sf):
    s = pile(spark, sf).groupBy("tid", "p", "sample").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("base") != F.col("ref")).alias("o"))
    loci = s.groupBy("tid", "p").agg(F.collect_list("o").alias("o"), F.collect_list("d").alias("d"))
    return loci.select("tid", "p", F.round(bias.segregation_bias(F.col("o"), F.col("d")), 5).alias("seg_bias")).filter("seg_bias is not null")


@query("WITH c AS (SELECT o_custkey % 97 AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS nref, count(*) FILTER (WHERE o_orderstatus <> 'F') AS nalt, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS nhets, count(*) + 210 AS nd FROM orders GROUP BY 1), d AS (SELECT *, 2.0 * nref * nalt / ((nref + nalt) * (nref + nalt)) AS q FROM c WHERE nref > 0 AND nalt > 0) SELECT k, round(exp(-0.5 * (nhets - q * nd) * (nhets - q * nd) / (q * nd * (1 - q))), 9) AS icb, round(abs(nhets / nd - q), 6) AS hob FROM d")
def icb_hob(spark, sf):
    s = F.col("o_orderstatus")
    c = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 97).alias("k")).agg(F.count_if(s == "F").alias("nref"), F.count_if(s != "F").alias("nalt"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("nhets"), (F.count(F.lit(1)) + 210).alias("nd"))
    c = c.filter("nref > 0 and nalt > 0")
    a = (F.col("nref"), F.col("nalt"), F.col("nhets"), F.col("nd"))
    return c.select("k", F.round(bias.inbreeding_column(*a), 9).alias("icb"), F.round(bias.heterozygote_bias(*a), 6).alias("hob"))


@query("""WITH c AS (SELECT o_custkey % 997 AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS nref, count(*) FILTER (WHERE o_orderstatus <> 'F') AS nalt, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS h, count(*) + 2 AS n FROM orders GROUP BY 1),
  d AS (SELECT *, 2.0 * nref * nalt / ((nref + nalt) * (nref + nalt)) AS q FROM c WHERE nref > 0 AND nalt > 0), e AS (SELECT *, q * n AS mean, floor(n * q) AS m FROM d)
  SELECT k, round(CASE WHEN (mean > 10 AND (1 - q) * n > 10) OR n > 200 THEN exp(-0.5 * (h - mean) * (h - mean) / (mean * (1 - q)))
    ELSE exp((lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1)) - (lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)) + (h - m) * (ln(q) - ln(1 - q))) END, 7) AS icb FROM e""")
def inbreeding_binomial(spark, sf):
    s = F.col("o_orderstatus")
    c = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 997).alias("k")).agg(F.count_if(s == "F").alias("nref"), F.count_if(s != "F").alias("nalt"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("h"), (F.count(F.lit(1)) + 2).alias("n"))
    return c.filter("nref > 0 and nalt > 0").select("k", F.round(bias.inbreeding_column(F.col("nref"), F.col("nalt"), F.col("h"), F.col("n")), 7).alias("icb"))


#: two-sided Fisher tests of the tables in t, by the hypergeometric probability of every table with their margins
FISHER = """f AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM t), x AS (SELECT *, unnest(generate_series(greatest(0, r + k - n), least(r, k))) AS x FROM f),
  v AS (SELECT *, CASE WHEN x = a THEN 1 ELSE 0 END AS own, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1)) AS pr FROM x),
  o AS (SELECT *, max(CASE WHEN own = 1 THEN pr END) OVER (PARTITION BY a, b, c, d) AS p0 FROM v),
  q AS (SELECT a, b, c, d, CAST(CASE WHEN least(a + b, c + d, a + c, b + d) < 2 THEN 0 ELSE least(255, floor(-4.343 * ln(greatest(sum(CASE WHEN pr <= p0 * (1 + 1e-7) THEN pr END), 1e-300)) + 0.499)) END AS INT) AS sp FROM o GROUP BY a, b, c, d)"""


@query(WP + f""", l AS (SELECT tid, p, count(*) FILTER (WHERE base = ref AND NOT rev) AS a, count(*) FILTER (WHERE base = ref AND rev) AS b, count(*) FILTER (WHERE base <> ref AND NOT rev) AS c, count(*) FILTER (WHERE base <> ref AND rev) AS d FROM pile GROUP BY tid, p),
  t AS (SELECT DISTINCT a, b, c, d FROM l), {FISHER} SELECT a, b, c, d, tid, p, sp FROM l JOIN q USING (a, b, c, d)""")
def fisher_strand(spark, sf):
    same, rev = F.col("base") == F.col("ref"), F.col("rev")
    t = pile(spark, sf).groupBy("tid", "p").agg(F.count_if(same & ~rev).alias("a"), F.count_if(same & rev).alias("b"), F.count_if(~same & ~rev).alias("c"), F.count_if(~same & rev).alias("d"))
    keys = t.select("a", "b", "c", "d").distinct()
    return t.join(keys.withColumn("sp", bias.fisher_column(*[F.col(x) for x in "abcd"])), ["a", "b", "c", "d"])


@query(W + """, m AS (SELECT tid, pos + len // 2 - 1 AS p, CASE WHEN partkey % 6 = 0 THEN CAST(partkey % 5 AS INT) - 2 ELSE 0 END AS length FROM reads WHERE NOT dup), t AS (SELECT tid, p, length, count(*) AS n FROM m GROUP BY ALL),
  s AS (SELECT tid, p, sum(n) AS depth, sum(CASE WHEN length <> 0 THEN n ELSE 0 END) AS support, count(*) AS n_types FROM t GROUP BY tid, p) SELECT tid, p, CAST(depth AS BIGINT) AS depth, CAST(support AS BIGINT) AS support, CAST(n_types AS INT) AS n_types FROM s WHERE support >= 1 AND support / depth >= 0.002""")
def indel_types(spark, sf):
    m = placed(spark, sf).select("tid", (F.col("pos") + F.floor(F.col("len") / 2).cast("int") - 1).alias("p"), F.when(F.col("partkey") % 6 == 0, (F.col("partkey") % 5).cast("int") - 2).otherwise(0).alias("length"))
    return indel.candidate_types(m).select("tid", "p", "depth", "support", F.size("types").alias("n_types"))


@query()
def levelling_downsample(spark, sf):
    r = placed(spark, sf).select("tid", "qid", "pos", "partkey", "price", (F.col("pos") + F.col("len") - 1).alias("stop")).withColumn("chunk", F.floor(F.col("pos") / 500).cast("int"))
    return downsample.levelled(r, ["tid", "chunk"], "pos", ["qid", "partkey", "price"], 40)


@query(WP + " SELECT tid, p, least(count(*), 12) AS depth FROM pile GROUP BY tid, p")
def depth_cap(spark, sf):
    return P.depth(downsample.capped(pile(spark, sf), ["tid", "p"], list(V.ORDER), 12))


def _drained(spark, out, mode: str, name: str):
    """The rows of a stream that has read all there is; its state goes to the shared folder.

    Appended rows go there too, as Parquet files; only complete results, which are small, are held by the driver.
    """
    import os
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir for the state of streams")
        base = tempfile.mkdtemp(prefix="strandflow-stream-")
    name = f"{name}_{os.getpid()}_{os.urandom(4).hex()}"
    to = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True)
    if mode != "append":
        to.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-rows")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # a stream without files writes none
    to.format("parquet").start(path.toString()).awaitTermination()
    return spark.read.schema(out.schema).parquet(path.toString())


def _events(spark, sf):
    import os

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a folder streams as it is, a file by a pattern that matches it alone
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*" if os.path.isfile(f"{sf}/events.parquet") else f"{sf}/events.parquet")


@query("SELECT event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS pos, event_id AS payload, false AS late FROM events")
def stream_sorted_writer(spark, sf):
    from ..streaming.cursor import sorted_writer

    rows = _events(spark, sf).select("event_type", F.unix_timestamp("ts").alias("pos"), F.col("event_id").alias("payload"))
    return _drained(spark, sorted_writer(rows, "event_type", "pos", "payload", 0), "append", "sorted")


@query("SELECT event_type, CAST(epoch_us(ts) // 1000000 // 21600 * 21600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    from ..streaming.cursor import chunk_counts

    events = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = chunk_counts(events, "ts", "1 day", "6 hours", "event_type")
    return _drained(spark, out.select("event_type", F.unix_timestamp("window.start").alias("start"), "n"), "complete", "windows")
