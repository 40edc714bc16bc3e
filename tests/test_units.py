"""Unit vectors of the numeric and text kernels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.config import GermlineConfig, SomaticConfig, from_options
from strandflow.functions import bases as B
from strandflow.functions import reads as R
from strandflow.functions import text as X
from strandflow.functions.lcg import JavaRandom
from strandflow.operators import alleles, bias, downsample, errmodel, indel, power
from strandflow.plans import germline
from strandflow.streaming.cursor import ForwardCursor


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_java_random():
    r = JavaRandom(1111111)
    assert [r.next_int() for _ in range(3)] == [-875981731, 199965190, -306597357]
    assert JavaRandom(47382911).sample_indices(9, 5) == [2, 3, 4, 1, 0]


def test_numbers_as_text(spark):
    vals = [1.234568, 1.23456, 1.2345, 1.234, 1.23, 1.2, 1.0, 0.0, -236.475073, 4.11663, 0.28536]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["t"] for r in rows.orderBy("i").select(X.round_nearest_text(F.col("v"), 6).alias("t")).collect()]
    assert got == ["1.234568", "1.23456", "1.2345", "1.234", "1.23", "1.2", "1", "0", "-236.475073", "4.11663", "0.28536"]
    x = F.lit(1.2345678)
    assert [one(spark, r=X.round_nearest(x, d))["r"] for d in (6, 5, 4, 3, 2, 1, 0)] == [1.234568, 1.23457, 1.2346, 1.235, 1.23, 1.2, 1.0]


@pytest.mark.parametrize(("n", "k", "e", "f", "want"), [(50, 5, 0.001, 0.1, -7.059164), (40, 5, 0.001, 0.1, -6.597727), (40, 10, 0.001, 0.1, -11.34971), (40, 10, 0.01, 0.1, -11.15482), (40, 10, 0.01, 0.2, -9.866713)])
def test_power_log_likelihood(n, k, e, f, want):
    assert power.log_likelihood(n, k, e, f) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("n", "d", "lod", "c", "want"), [(50, 0.15, 6.3, 0, 0.975342), (20, 0.15, 6.3, 0, 0.6364833), (10, 0.15, 6.3, 0, 0.3167154), (50, 0.35, 6.3, 0, 0.9999994), (50, 0.05, 6.3, 0, 0.3893047), (50, 0.05, 4.3, 0, 0.6068266), (50, 0.05, 4.3, 0.02, 0.0039135)])
def test_tumor_power(n, d, lod, c, want):
    assert power.tumor_power(n, d, 1e-3 / 3, lod, c) == pytest.approx(want, abs=1e-4)


def test_cigar_and_fragments(spark):
    e = R.cigar_elements(F.lit("2S8M2I3D4M"))
    r = one(spark, text=R.cigar_text(e), end=R.alignment_end(F.lit(10), e), n=R.read_length(e), clip=R.soft_clip_fraction(e), blocks=R.blocks(e), none=F.size(R.cigar_elements(F.lit("*"))), q=R.indel_quality(40, 20, 100, F.lit(-2), F.lit(4)))
    assert (r["text"], r["end"], r["n"], r["none"], r["q"]) == ("2S8M2I3D4M", 24, 16, 0, 50)
    assert r["clip"] == pytest.approx(2 / 19) and [(b["op"], b["ref0"], b["read0"]) for b in r["blocks"]] == [("S", 0, 0), ("M", 0, 2), ("I", 8, 10), ("D", 8, 12), ("M", 11, 12)]
    lit = F.lit
    r = one(spark, f=R.adaptor_boundary(lit(0x1 | 0x20), lit(100), lit(150), lit(180), lit(90)), b=R.adaptor_boundary(lit(0x1 | 0x10), lit(100), lit(150), lit(80), lit(-70)), none=R.adaptor_boundary(lit(0x1), lit(100), lit(150), lit(180), lit(90)), long_=R.inside_adaptor(lit(999), lit(191), lit(0x21), lit(101)), short=R.inside_adaptor(lit(191), lit(191), lit(0x21), lit(90)))
    assert (r["f"], r["b"], r["none"], r["long_"], r["short"]) == (191, 79, None, False, True)


def test_bases_and_labels(spark):
    r = one(spark, i=F.array(*[B.base_index(F.lit(b)) for b in "AcgT*N"]), m=B.iupac(F.lit("c"), F.lit("T")), p=B.phred(F.lit(0.0)), ctx=B.sequence_context(F.lit("acgtacgt"), F.lit(3)), edge=B.sequence_context(F.lit("acgt"), F.lit(0)), q=B.decode_quality(F.lit("!I")), g=B.genotype_index(F.lit(2), F.lit(1)), tags=X.header_tags(F.lit("@SQ\tSN:chr1\tLN:10:x\tbad")), tok=X.tokenize(F.lit(",a,,b"), ","), info=X.vcf_info(F.lit("A=1;F;B=x=y")), loc=X.locus_text(F.lit("c"), F.lit(3), F.lit(5)), sym=X.symbolic_allele(F.lit("<DEL>")))
    assert list(r["i"]) == [0, 1, 2, 3, 0, -1] and r["m"] == "Y" and r["p"] == 99 and r["ctx"] == "ACGxACG" and r["edge"] == "xCGT" and list(r["q"]) == [0, 40] and r["g"] == 4
    assert r["tags"] == {"SN": "chr1", "LN": "10"} and list(r["tok"]) == ["a", "b"] and r["info"] == {"A": "1", "F": "", "B": "x=y"} and r["loc"] == "c:3-5" and r["sym"]


def test_bias_statistics():
    rng = random.Random(1)
    for _ in range(20):
        a, b = [rng.randint(0, 2) for _ in range(5)], [rng.randint(0, 1) for _ in range(5)]
        xs = [i for i, c in enumerate(a) for _ in range(c)]
        ys = [i for i, c in enumerate(b) for _ in range(c)]
        if xs and ys:
            u = sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
            assert bias._u(a, b)[0] == u
    assert sum(bias._u_exact(5, 4)) == pytest.approx(1) and bias._u_exact(2, 1) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert bias.mann_whitney([9, 0], [0, 0]) is None and bias.mann_whitney([1, 0], [3, 2]) == 1.0 and bias.mann_whitney([10, 10], [10, 10]) == pytest.approx(1)
    assert bias.chi_square([5, 5], [5, 5]) == 1.0 and bias.chi_square([20, 0], [0, 20]) == pytest.approx(math.exp(-20), rel=1e-6)
    assert bias.fisher_phred(1, 9, 11, 3) == int(-4.343 * math.log(0.0027594561852200836) + 0.499) and bias.fisher_phred(1, 0, 9, 9) == 0
    assert bias.variant_distance_bias([0] * 99 + [1]) is None and 0 <= bias.variant_distance_bias([1] * 100) <= 1 and bias.variant_distance_bias([5] + [0] * 99) < 0.1
    assert bias.binomial_ratio(10, 0.5, 5) == 1.0 and bias.binomial_ratio(10, 0.5, 4) == pytest.approx(210 / 252)


def test_error_model_prefers_the_right_genotype():
    lk = errmodel.likelihoods(np.array([0] * 20), np.array([30] * 20), np.array([0, 1] * 10))
    assert lk[0, 0] == 0 and lk[0, 1] > 30 and lk[1, 1] > 100
    lk = errmodel.likelihoods(np.array([0, 1] * 10), np.array([30] * 20), np.array([0, 0, 1, 1] * 5))
    assert lk[0, 1] < lk[0, 0] and lk[0, 1] < lk[1, 1]


def test_multiallelic_call():
    site = {"tid": 0, "p": 5, "ref": "A", "alleles": ["A", "C"], "allele_qs": [0.5, 1.5], "depth": 40, "anno": [10] * 12, "samples": [{"sample": "x", "bases": [{"base": b, "q": 30, "rev": r, "n": 5} for b in "AC" for r in (False, True)]}, {"sample": "y", "bases": [{"base": "C", "q": 30, "rev": r, "n": 10} for r in (False, True)]}]}
    out = germline.call_site(site, GermlineConfig())
    assert [s["gt"] for s in out["samples"]] == ["0/1", "1/1"] and out["alt"] == ["C"] and out["ac"] == [3] and out["qual"] > 50
    site["samples"] = [{"sample": "x", "bases": [{"base": "A", "q": 30, "rev": False, "n": 20}]}]
    assert germline.call_site(site | {"alleles": ["A"], "allele_qs": [1.0]}, GermlineConfig()) is None


def test_downsampling_levels_groups():
    assert downsample.level([5, 1, 9], 9) == [4, 1, 4] and downsample.level([3, 3], 10) == [3, 3]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        target = rng.randint(1, 40)
        got = downsample.level(sizes, target)
        assert sum(got) == max(min(sum(sizes), target), min(len(sizes), sum(sizes))) and all(1 <= g <= s for g, s in zip(got, sizes))
    assert downsample.file_depth(250, 8000, 4) == 2000 and downsample.file_depth(250, 8000, 40) == 250


def test_numbers_as_text_round_what_the_double_holds(spark):
    rng = random.Random(4)
    values = [0.0375, 0.0875, -0.0375, 0.125, 0.375, 2.5, 0.5, 1.5, 0.0005, 0.00049, 1e9 + 0.5, 123456.0005] + [rng.randint(0, 4000) / 8000 for _ in range(300)] + [rng.uniform(-1e4, 1e4) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 3, 6):
        got = [r[0] for r in df.select(X.round_nearest_text(F.col("v"), digits)).collect()]
        for v, g in zip(values, got):
            want = f"{v:.{digits}f}"
            want = (want.rstrip("0").rstrip(".") if digits else want) if abs(v) >= 5.0 * 10.0 ** -(digits + 1) else "0"
            assert g == want, (v, digits)


def test_significant_digits(spark):
    rng = random.Random(8)
    values = [0.0, 1.0, 488.0, 3.10664, 0.842082, -4.22417, 999999.5, 1e6, 1234567.0, 0.0001, 0.00012345678, 9.9999996e-5, 1e-300, 100.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.significant(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in values]


def test_error_model_equals_a_walk_over_bases():
    rng = np.random.default_rng(6)
    for n in (1, 7, 60, 400):
        base, quality, reverse = rng.integers(0, 4, n), rng.integers(2, 70, n), rng.integers(0, 2, n)
        order = sorted(range(n), key=lambda i: (-quality[i], reverse[i], base[i]))[:255]
        seen, count, errors = {}, [0] * 5, [0.0] * 5
        for i in order:
            b, k = int(base[i]), (int(base[i]), int(reverse[i]))
            q = min(63, max(4, int(quality[i])))
            errors[b] += errmodel._weights()[seen.get(k, 0)] * errmodel._beta(q, len(order))[count[b]]
            seen[k] = seen.get(k, 0) + 1
            count[b] += 1
        got = errmodel.likelihoods(base, quality, reverse)
        assert np.allclose([got[j, j] for j in range(5)], [sum(e for k, e in enumerate(errors) if k != j and count[k]) for j in range(5)])


def test_query_positions_and_repeats(spark):
    at = lambda cigar, target: one(spark, x=indel.query_position(R.cigar_elements(F.lit(cigar)), F.lit(10), F.lit(target)))["x"]
    assert [at("2S3M2D4M", t) for t in (9, 10, 12, 13, 14, 15, 18, 40)] == [2, 2, 4, 5, 5, 5, 8, 9]
    assert at("5M3S", 99) == 5 and at("5M3I", 99) == 5 and at("2M3N2M", 13) == 2
    reach = lambda ref, pos, n, ins=None: one(spark, x=indel.repeat_extent(F.lit(ref), F.lit(pos), F.lit(n), F.lit(ins) if ins else None))["x"]
    assert reach("TACACACGG", 0, -2) == 6 and reach("TAAAAG", 0, 1, "A") == 4 and reach("TGGG", 0, 1, "A") == 0
    assert reach("T" + "A" * 20 + "C" + "A" * 30, 0, 1, "a") == 51


def test_homopolymer_runs(spark):
    import itertools

    cases = [(r, p) for r in ("ACGGGT", "AAAA", "acCCt", "G", "") for p in range(-1, 5)]
    df = spark.createDataFrame(cases, "ref string, p int").select(indel.homopolymer_run(F.col("ref"), F.col("p")).alias("n"))
    want = [0 if p + 1 >= len(r) else [len(list(g)) for _, g in itertools.groupby(r.upper()) for g in [list(g)] for _ in g][p + 1] for r, p in cases]
    assert [x["n"] for x in df.collect()] == want


def test_indel_and_allele_helpers():
    assert indel.glocal_score("A" * 30 + "ACGTACGTAC", "GTACG", np.full(5, 30)) < 20
    assert indel.glocal_score("ACGTACGTAC", "GTACG", np.full(5, 30)) < indel.glocal_score("ACGTACGTAC", "GTTTG", np.full(5, 30))
    assert indel.top_types({0: 1, 1: 9, -2: 4, 3: 4, 5: 2}) == [0, 1, -2, 3]
    assert alleles.find_allele(["C", "CT"], ["CTA", "CTTA"], 1) == 1 and alleles.find_allele(["C", "G"], ["A", "T"], 1) == -1
    assert alleles.mendelian_prior((0, 1), (0, 1), (0, 1)) == 0.5 and alleles.trio_genotypes(np.array([0.1, 0.8, 0.1]), np.array([0.9, 0.05, 0.05]), np.array([0.1, 0.8, 0.1])) == ((0, 1), (0, 0), (0, 1))


def test_trios_over_tables_equal_every_combination(spark):
    import itertools

    rng = random.Random(13)
    people, sites = ["f", "m", "c", "x", "d"], []
    for p in range(40):
        n = rng.choice([2, 3])
        sites.append((0, p, ["T"] * (n - 1), [(s, "./.", 0, [rng.randrange(120) for _ in range(n * (n + 1) // 2)]) for s in people if (s, p) != ("m", 7)]))
    calls = spark.createDataFrame(sites, "tid int, p int, alt array<string>, samples array<struct<sample:string,gt:string,gq:int,pl:array<int>>>")
    families = spark.createDataFrame([("c", "f", "m"), ("d", "x", "m"), ("z", "f", "m")], "sample string, father string, mother string")
    got = {(r["p"], r["sample"]): r for r in alleles.trios(calls, families).collect()}
    assert set(got) == {(p, s) for p in range(40) if p != 7 for s in "cd"}
    for (p, s), r in got.items():
        pl, n = {x[0]: x[3] for x in sites[p][3]}, len(sites[p][2]) + 1
        gts = [(a, b) for b in range(n) for a in range(b + 1)]
        value = lambda f, m, c: 10 ** (-(pl[r["father"]][gts.index(f)] + pl[r["mother"]][gts.index(m)] + pl[s][gts.index(c)]) / 10) * alleles.mendelian_prior(f, m, c)  # noqa: E731, B023
        top = max(value(*g) for g in itertools.product(gts, repeat=3))
        own = [tuple(map(int, r[k].split("/"))) for k in ("father_gt", "mother_gt", "gt")]
        assert math.isclose(value(*own), top, rel_tol=1e-9)
        assert r["mendelian"] == any(tuple(sorted(w)) == own[2] for w in itertools.product(own[0], own[1]))


def test_forward_cursor():
    c = ForwardCursor(iter([(10438, "a"), (10438, "b"), (10439, "c"), (10491, "d"), (10518, "e"), (10600, "f")]))
    assert [len(c.seek(a, b)) for a, b in ((10438, 10438), (10439, 10439), (10440, 10440), (10440, 10519))] == [2, 1, 0, 2]
    with pytest.raises(ValueError):
        c.seek(10000, 10519)
    with pytest.raises(ValueError):
        ForwardCursor(iter([(5, 1), (3, 1)])).seek(0, 9)


def test_options():
    cfg = from_options(SomaticConfig, ["--tumor-lod=5", "--force_output", "--min-qscore", "7"])
    assert (cfg.tumor_lod, cfg.force_output, cfg.min_qscore) == (5.0, True, 7) and cfg.effective().initial_tumor_lod < -1e38
    with pytest.raises(ValueError):
        from_options(SomaticConfig, ["--nothing"])
