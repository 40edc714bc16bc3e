"""Text readers and sinks over small files."""

from pyspark.sql import functions as F

from strandflow.functions import reads as R
from strandflow.operators import downsample, intervals
from strandflow.operators import pileup as P
from strandflow.sinks import calls
from strandflow.sources import regions, sam, vcf

SAM = """@HD\tVN:1.0
@SQ\tSN:chr1\tLN:101
@SQ\tSN:chr2\tLN:101
@RG\tID:0\tSM:s
a\t73\tchr2\t1\t255\t8M2I\t*\t0\t0\tCAACAGAAGC\t)'.*.+2,))\tRG:Z:0
b\t0\tchr1\t5\t60\t4M2D3M1N2M\t=\t9\t20\tACGTACGTA\tIIIIIIIII
c\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_sam(spark, tmp_path):
    path = write(tmp_path, "x.sam", SAM)
    head = sam.header(spark, path)
    names = sam.contigs(head)
    rows = {r["qname"]: r for r in sam.scan(spark, path, names).collect()}
    assert len(rows) == 3 and rows["a"]["tid"] == 1 and rows["a"]["pos"] == 0 and rows["a"]["stop"] == 7 and rows["a"]["tags"] == {"RG": "0"} and rows["a"]["qual"][:2] == [8, 6]
    assert rows["b"]["mate_contig"] == "chr1" and rows["c"]["contig"] is None and rows["c"]["seq"] == ""
    reads = sam.scan(spark, path).filter(R.placed_read(F.col("flag"), F.col("pos")))
    pile = [(r["p"], r["base"], r["is_del"]) for r in P.unnest(reads.filter("qname = 'b'"), ["qname"], seq="seq", qual="qual").orderBy("p").collect()]
    assert pile == [(4, "A", False), (5, "C", False), (6, "G", False), (7, "T", False), (8, "D", True), (9, "D", True), (10, "A", False), (11, "C", False), (12, "G", False), (14, "T", False), (15, "A", False)]
    assert sam.region(sam.scan(spark, path), "chr1", 0, 5, "contig").count() == 1 and sam.regions(sam.scan(spark, path), [("chr1", 0, 9), ("chr1", 5, 9)], "contig").count() == 2
    assert [tuple(r) for r in sam.read_groups(head, "f").orderBy("rg").collect()] == [("f", None, "s"), ("f", "0", "s")]
    assert sam.parse_region("chr1:2-9") == ("chr1", 1, 9) and sam.parse_region("x") == ("x", 0, None)


def test_regions_and_fasta(spark, tmp_path):
    lst = write(tmp_path, "i.list", "@SQ\tSN:X\tLN:1000\nX\t10\t20\t+\ta\nX\t21\t30\t+\tb\nX\t40\t5000\t+\tout\nX\t40\t50\tbad\nX\t40\t50\t-\tc\n")
    iv = regions.interval_list(spark, lst)
    assert [(r["start"], r["stop"]) for r in iv.orderBy("start").collect()] == [(9, 19), (20, 29), (39, 49)]
    assert [(r["start"], r["stop"]) for r in intervals.merge(iv, ["contig"]).orderBy("start").collect()] == [(9, 29), (39, 49)]
    b = write(tmp_path, "r.bed", "# c\ntrack x\nc1\t5\t9\nc1\t7\n")
    assert sorted((r["beg"], r["end"]) for r in regions.bed(spark, b).collect()) == [(5, 9), (6, 7)]
    assert sorted((r["start"], r["stop"]) for r in regions.region_file(spark, b).collect()) == [(5, 8), (6, 6)]
    fa = write(tmp_path, "r.fa", ">one desc\nACGTACG\nTTT\n>two\nGG\n")
    ref = regions.fasta(spark, fa, 4)
    assert {r["contig"]: r["length"] for r in regions.sequence_lengths(ref).collect()} == {"one": 10, "two": 2}
    got = regions.fetch(ref, spark.createDataFrame([("one", 2, 8), ("two", 0, 1), ("one", 0, 0)], "contig string, start long, stop long"), 4)
    assert sorted(r["bases"] for r in got.collect()) == ["A", "GG", "GTACGTT"]
    st = write(tmp_path, "s.txt", "# tool\nSN\treads:\t5\t# c\nFFQ\t1\t3\t4\n")
    assert [(r["section"], r["key"], r["values"]) for r in regions.statistics(spark, [st], "tool").orderBy("section").collect()] == [("FFQ", "1", [3.0, 4.0]), ("SN", "reads", [5.0])]


def test_vcf_and_sinks(spark, tmp_path):
    text = '##fileformat=VCFv4.1\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d, e">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nchr1\t10\trs1\tA\tC,G\t5.5\tPASS\tDP=3;DB\tGT:PL\t0/1:1,2\nbroken\nchr1\t20\t.\tC\t.\t.\t.\t.\n'
    path = write(tmp_path, "v.vcf", text)
    v = vcf.info_columns(vcf.scan(spark, path), {"DP": "int", "DB": "flag"})
    rows = [(r["pos"], r["id"], list(r["alt"]), r["qual"], r["DP"], r["DB"]) for r in v.orderBy("pos").collect()]
    assert rows == [(9, "rs1", ["C", "G"], 5.5, 3, True), (19, None, [], None, None, False)] and vcf.samples(spark, path) == ["S"] and vcf.region(v, "chr1", 0, 9).count() == 1
    assert vcf.header(spark, path).first()["id"] == "DP"
    lines = spark.createDataFrame([(0, p, f"l{p}") for p in (5, 1, 3)], "tid int, p int, line string")
    calls.write_sorted(lines, str(tmp_path / "out"), "#h")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["#h", "l1", "l3", "l5"]
    assert len(calls.CALL_STATS) == 51


def test_range_joins(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 100, 3000), (1, 9000, 9001), (2, 0, 5)], "k int, a int, b int")
    b = spark.createDataFrame([(1, 5, 7), (1, 2000, 2000), (1, 2500, 9500)], "k int, c int, d int")
    inner = intervals.range_join(a, b, ["k"], "a", "b", "c", "d", width=64)
    assert sorted((r["a"], r["c"]) for r in inner.collect()) == [(0, 5), (100, 2000), (100, 2500), (9000, 2500)]
    semi = intervals.range_join(a, b, ["k"], "a", "b", "c", "d", "left_semi", 64)
    anti = intervals.range_join(a, b, ["k"], "a", "b", "c", "d", "left_anti", 64)
    assert sorted(r["a"] for r in semi.collect()) == [0, 100, 9000] and [tuple(r) for r in anti.collect()] == [(2, 0, 5)]


def test_levelled_reads(spark):
    r = spark.createDataFrame([(0, i // 10, 50, i) for i in range(40)], "k int, pos int, stop int, i int")
    out = downsample.levelled(r, ["k"], "pos", ["i"], 12).toPandas()
    assert len(out) == 12 and (out.groupby("pos").size() == 3).all()


def bgzf(raw: bytes) -> bytes:
    import struct
    import zlib

    out = b""
    for at in range(0, len(raw), 60):
        part = raw[at : at + 60]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    import struct

    from strandflow.sources.bam import BamSource

    head = b"@HD\tVN:1.0\n"
    raw = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 100)
    for i in range(20):
        name, ops, seq = f"r{i}".encode() + b"\0", [(5 << 4) | 0, (2 << 4) | 2, (3 << 4) | 0], "ACGTACGT"
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 60, 0, len(ops), 99, len(seq), -1, -1, 7) + name + struct.pack("<3I", *ops) + bytes("=ACMGRSVTWYHKDBN".index(seq[k]) << 4 | "=ACMGRSVTWYHKDBN".index(seq[k + 1]) for k in range(0, 8, 2)) + bytes([30] * 8) + b"RGZx\0NMi" + struct.pack("<i", 2) + b"ZZBs" + struct.pack("<ihh", 2, 1, -1)
        raw += struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf(raw))
    spark.dataSource.register(BamSource)
    rows = spark.read.format("strandflow_bam").load(str(tmp_path / "a.bam")).orderBy("pos").collect()
    assert len(rows) == 20 and rows[3]["qname"] == "r3" and rows[3]["cigar"] == "5M2D3M" and rows[3]["seq"] == "ACGTACGT" and rows[3]["stop"] == 12 and rows[3]["tags"] == {"RG": "x", "NM": "2", "ZZ": "s,1,-1"} and rows[3]["contig"] == "chr1" and rows[3]["qual"] == [30] * 8


def test_repeated_regions_and_positions_are_counted_before_they_meet(spark, sf, tmp_path):
    import duckdb

    from strandflow import queries as Q

    for t, key in (("part", "p_partkey"), ("orders", "o_orderkey")):
        d = spark.read.parquet(f"{sf}/{t}.parquet")
        d.crossJoin(spark.range(5)).withColumn(key, F.col(key) + F.col("id") * 7_000_000).drop("id").write.parquet(f"{tmp_path}/{t}.parquet")
    out = Q.QUERIES["range_join_cursor"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # both sides and the pairs
    duck = duckdb.connect()
    for t in ("part", "orders"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = [tuple(r) for r in duck.execute(Q.SQL["range_join_cursor"]).fetchall()]
    assert sorted(tuple(r) for r in out.select("tid", "a", "b", "hits", "first_id").collect()) == sorted(want) and want


def test_lookups_and_range_joins_do_not_lean_on_row_numbers(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 500, "y"), (2, 5, "z"), (None, 5, "n"), (1, None, "m")], "k int, p int, t string")
    ranges = spark.createDataFrame([(1, 0, 9, 7), (1, 5, 5, 8), (2, 6, 9, 9)], "k int, a int, b int, v int")
    found = intervals.lookup_with_default(left, ranges, ["k"], "p", "a", "b", "v", F.lit(0))
    assert found.columns == ["k", "p", "t", "v"]
    assert sorted((r["t"], r["v"]) for r in found.collect()) == [("m", 0), ("n", 0), ("x", 7), ("x", 7), ("y", 0), ("z", 0)]
    spans = spark.createDataFrame([(1, 0, 900, "x"), (1, 0, 900, "y"), (1, 100, 900, "z")], "k int, s int, e int, t string")
    semi = intervals.range_join(spans, ranges, ["k"], "s", "e", "a", "b", "left_semi", 64)
    assert sorted(r["t"] for r in semi.collect()) == ["x", "y"]
    for df in (found, semi):  # rows of a shuffle are numbered anew each time they are worked out
        assert "monotonically" not in df._jdf.queryExecution().optimizedPlan().toString()
