"""Insertions and deletions planted in reads are found again, and nothing else."""

import random

from strandflow.plans import indels
from strandflow.sources import regions, sam


def test_planted_indels_are_called(spark):
    rnd = random.Random(23)
    ref = "".join(rnd.choice("ACGT") for _ in range(600))
    ref = ref[:150] + "GATC" + ref[154:]
    alt = {"ins": (150, "GTT", 0), "del": (400, "", 3)}
    lines = []

    def read(name, sample, start, kind, flag):
        at, bases, gone = alt[kind] if kind else (None, "", 0)
        before = at - start + 1 if kind else 0
        if kind and 5 < before < 75:
            seq = ref[start : at + 1] + bases + ref[at + 1 + gone : start + 80]
            cigar = f"{before}M{len(bases)}I{80 - before}M" if bases else f"{before}M{gone}D{80 - before - gone}M"
        else:
            seq, cigar = ref[start : start + 80], "80M"
        seq = "".join(c if rnd.random() > 0.004 else rnd.choice("ACGT") for c in seq)
        lines.append((sample, f"{name}\t{flag}\tone\t{start + 1}\t60\t{cigar}\t*\t0\t0\t{seq}\t{'I' * len(seq)}"))

    for sample in ("x", "y"):
        for i in range(60):
            for kind, at in (("ins", 150), ("del", 400)):
                planted = (kind == "ins" and i % 2 == 0) or (kind == "del" and sample == "y")
                read(f"{sample}{i}{kind}", sample, at - rnd.randint(10, 70), kind if planted else None, rnd.choice([0, 16]))
    names = spark.createDataFrame([(0, "one")], "tid int, contig string")
    reads = None
    for s in ("x", "y"):
        own = sam.records(spark.createDataFrame([(line,) for k, line in lines if k == s], "value string"), names).selectExpr("*", f"'{s}' AS sample")
        reads = own if reads is None else reads.unionByName(own)
    fasta = regions.fasta_of(spark.createDataFrame([(x,) for x in [">one", *[ref[i : i + 60] for i in range(0, 600, 60)]]], "value string").coalesce(1), 64)
    got = {r["p"]: r for r in indels.call(reads, fasta, chunk=64).collect()}
    assert set(got) == {150, 400}
    ins, gone = got[150], got[400]
    assert (ins["ref"], ins["alt"]) == (ref[150], [ref[150] + "GTT"]) and {s["sample"]: s["gt"] for s in ins["samples"]} == {"x": "0/1", "y": "0/1"}
    assert (gone["ref"], gone["alt"]) == (ref[400:404], [ref[400]]) and {s["sample"]: s["gt"] for s in gone["samples"]} == {"x": "0/0", "y": "1/1"}
    assert ins["idv"] == sum("I" in line.split("\t")[5] for _, line in lines) and 0.3 < ins["imf"] < 0.7
    assert indels.call(reads, fasta, chunk=64, max_depth=5).count() == 0
