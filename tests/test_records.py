"""Records, reference and targets to calls, against a walk read by read."""

import random
import re

import pytest

from strandflow.plans import records
from strandflow.sources import regions, sam


def reference_text(rnd):
    return {c: "".join(rnd.choice("ACGT") for _ in range(400)) for c in ("one", "two")}


def sam_lines(ref, rnd, n=60):
    out = []
    for sample in ("TUMOR", "NORMAL"):
        for i in range(n):
            for contig in ("one", "two"):
                pos = rnd.randrange(0, 340)
                cigar = rnd.choice(["40M", "40M", "40M", "3S20M2D20M", "20M3I20M", "10M30N20M", "2D30M", "15S20M"])
                if i % 2 == 0 and contig == "one":
                    pos, cigar = 150 - rnd.randrange(40), "40M"
                flag = rnd.choice([0, 0, 16, 16, 1024, 256])
                seq, at = "", pos
                for k, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNS])", cigar)):
                    if op == "M":
                        seq += ref[contig][at : at + k].ljust(k, "A")
                    elif op in "IS":
                        seq += "".join(rnd.choice("ACGTN") for _ in range(k))
                    at += k if op in "MDN" else 0
                seq = list(seq)
                if cigar == "40M" and contig == "one" and pos <= 150 < pos + 40 and sample == "TUMOR" and i % 2 == 0:
                    seq[150 - pos] = "ACGT"["ACGT".index(ref["one"][150]) - 1]
                if contig == "two" and cigar == "40M" and pos <= 200 < pos + 40 and i % 2:
                    seq[200 - pos] = "ACGT"["ACGT".index(ref["two"][200]) - 1]
                qual = "".join(chr(33 + rnd.randint(25, 40)) for _ in seq)
                out.append((sample, f"{sample}{i}{contig}\t{flag}\t{contig}\t{pos + 1}\t60\t{cigar}\t*\t0\t0\t{''.join(seq)}\t{qual}"))
    return out


def walk(lines, ref, targets, heavy=0.3, most=100):
    """(sample, name, contig, p, ref, base, is_del, offset, clean) of every position, one read after the other."""
    out = []
    for sample, line in lines:
        name, flag, contig, pos, _, cigar, *_, seq, qual = line.split("\t")
        flag, p, off = int(flag), int(pos) - 1, 0
        if flag & (4 | 256 | 512 | 1024):
            continue
        ops = [(int(a), b) for a, b in re.findall(r"(\d+)([MIDNS])", cigar)]
        clipped = sum(a for a, b in ops if b == "S") / sum(a for a, _ in ops) >= heavy - 1e-9
        rows = []
        for k, op in ops:
            for j in range(k):
                if op in "MD" and p + j < len(ref[contig]):
                    o = off + j if op == "M" else off - 1
                    base = seq[o] if op == "M" else "D"
                    if base != "N":
                        rows.append((p + j, ref[contig][p + j], base, op == "D", o, ord(qual[o]) - 33 if o >= 0 else 0))
            p += k if op in "MDN" else 0
            off += k if op in "MIS" else 0
        if not any(a <= p - 1 and int(pos) - 1 <= b for c, a, b in targets if c == contig):
            continue
        for at, r, base, gone, o, _ in rows:
            bad = sum(q for a, x, y, g, _, q in rows if abs(a - at) <= 150 and not g and x != y)
            if any(a <= at <= b for c, a, b in targets if c == contig):
                out.append((sample, name, contig, at, r, base, gone, o, not clipped and bad <= most))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(17)
    ref = reference_text(rnd)
    lines = sam_lines(ref, rnd)
    text = [x for c, s in ref.items() for x in [f">{c} x", *[s[i : i + 70] for i in range(0, 400, 70)]]]
    fasta = regions.fasta_of(spark.createDataFrame([(x,) for x in text], "value string").coalesce(1), 64)
    names = spark.createDataFrame([(0, "one"), (1, "two")], "tid int, contig string")
    reads = None
    for s in ("TUMOR", "NORMAL"):
        one = sam.records(spark.createDataFrame([(line,) for k, line in lines if k == s], "value string"), names)
        one = one.selectExpr("*", f"'{s}' AS sample")
        reads = one if reads is None else reads.unionByName(one)
    return ref, lines, reads, fasta


def test_pile_of_records_equals_a_walk(spark, world):
    ref, lines, reads, fasta = world
    targets = [("one", 20, 180), ("one", 181, 260), ("two", 0, 399)]
    t = spark.createDataFrame(targets, "contig string, start long, stop long")
    got = records.pile(reads, fasta, t, chunk=64, fold=False).select("sample", "name", "contig", "p", "ref", "base", "is_del", "offset", "clean").collect()
    assert sorted(map(tuple, got)) == sorted(walk(lines, ref, targets))


def test_records_are_called(spark, world):
    ref, _, reads, fasta = world
    rows = {(r["contig"], r["p"]): r for r in records.somatic_calls(reads, fasta, chunk=64).collect()}
    hit = rows["one", 150]
    assert hit["ref"] == ref["one"][150] and hit["alt"] == "ACGT"["ACGT".index(ref["one"][150]) - 1] and hit["judgement"] == "KEEP", hit["reasons"]
    assert hit["context"] == ref["one"][147:150] + "x" + ref["one"][151:154]
    assert [k for k, r in rows.items() if r["judgement"] == "KEEP"] == [("one", 150)]
    found = {(r["tid"], r["p"]): r for r in records.germline_calls(reads, fasta, chunk=64).collect()}
    site = found[1, 200]
    assert site["alt"] == ["ACGT"["ACGT".index(ref["two"][200]) - 1]] and {s["gt"] for s in site["samples"]} & {"0/1", "1/1"}
