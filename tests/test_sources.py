import gzip
import struct
import zlib

import numpy as np
import pytest

from lociforge.sources import binary, sinks, text


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_beagle(spark, tmp_path):
    p = write(tmp_path / "b.txt", ["marker allele1 allele2 Ind0 Ind0 Ind0 Ind1 Ind1 Ind1", "chr_1_1_5 c a 0.9 .05 .05 0.8 .10 .10", "1_7\tg\t3\t0.9\t.05\t.05\t0.6\t.20\t.20"])
    got = {r["pos"]: r for r in text.beagle(spark, p).collect()}
    assert got[4]["chr"] == "chr_1_1" and got[4]["major"] == 1 and got[4]["minor"] == 0 and got[4]["probs"] == [[0.9, 0.05, 0.05], [0.8, 0.1, 0.1]]
    assert got[6]["chr"] == "1" and got[6]["minor"] == 3


def test_mpileup(spark, tmp_path):
    p = write(tmp_path / "p.txt", ["1\t10\tA\t4\t.,+2ACt^]G$\tIIII\t2\t*-1gc\tI5", "1\t11\tC\t0\t*\t*\t1\t,\t+"])
    got = sorted((r["pos"], r["sample"], r["ord"], r["base"], r["qs"], r["is_rev"]) for r in text.mpileup(spark, p).collect())
    assert got == [(9, 0, 0, 0, 40, False), (9, 0, 1, 0, 40, True), (9, 0, 2, 3, 40, True), (9, 0, 3, 2, 40, False), (9, 1, 1, 1, 20, True), (10, 1, 0, 1, 10, True)]


def test_vcf(spark, tmp_path):
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb", "1\t5\t.\tG\tA,<*>\t.\t.\tDP=3\tPL:DP\t20,0,30:3\t.:0", "1\t6\t.\tG\tGA\t.\t.\tINDEL;DP=3\tPL\t1,2,3\t1,2,3", "1\t7\t.\tG\tA\t.\t.\tDP=2\tGT:GP\t0/0:0.8,0.1,0.1\t./.:."]
    p = write(tmp_path / "v.vcf", lines)
    got = {(r["pos"], r["sample"]): r["gl"] for r in text.vcf(spark, p).collect()}
    assert set(got) == {(4, 0), (4, 1)} and got[4, 1] == [0.0] * 10
    want = np.full(10, -1e30)
    want[[7, 2, 0]] = -np.log(10) / 10 * np.array([20, 0, 30])
    assert np.allclose(got[4, 0], want)
    gp = text.vcf(spark, p, "GP").collect()
    assert [(r["pos"], r["sample"], r["major"], r["minor"], round(r["p0"], 3)) for r in sorted(gp, key=lambda r: r["sample"])] == [(6, 0, 2, 0, 0.8), (6, 1, 2, 0, 0.333)]


def test_sam_and_headers(spark, tmp_path):
    head = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:1\tLN:30"]
    p = write(tmp_path / "a.sam", [*head, "r1\t16\t1\t3\t60\t4M\t*\t0\t0\tACGN\tIIII\tRG:Z:x\tX0:i:1"])
    r = text.sam(spark, p).first()
    assert (r["qname"], r["flag"], r["pos"], r["rg"], r["tags"]["X0"]) == ("r1", 16, 3, "x", "1")
    text.check_headers(spark, [p, p])
    with pytest.raises(ValueError):
        text.check_headers(spark, [p, write(tmp_path / "b.sam", [head[0], "@SQ\tSN:1\tLN:31"])])


def test_fasta_and_lists(spark, tmp_path):
    p = write(tmp_path / "r.fa", [">1 first", "AAC", "GN", ">2", "T"])
    got = sorted((r["chr"], r["pos"], r["base"]) for r in text.fasta_bases(text.fasta(spark, p)).where("base is not null").collect())
    assert got == [("1", 0, 0), ("1", 1, 0), ("1", 2, 1), ("1", 3, 2), ("2", 0, 3)]
    long = write(tmp_path / "long.fa", [x for c in "ab" for x in [f">{c}", *["ACGTA" if i % 3 else "CC" for i in range(200)]]])
    want = {(c, i): x for c in "ab" for i, x in enumerate("".join("ACGTA" if i % 3 else "CC" for i in range(200)))}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        split = text.fasta(spark, long)
        assert spark.read.text(long).rdd.getNumPartitions() > 1
        assert {(r["chr"], r["start"] + k): x for r in split.collect() for k, x in enumerate(r["seq"])} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text.fai(spark, write(tmp_path / "r.fai", ["1\t5\t9\t3\t4"])).first()["length"] == 5
    assert [tuple(r) for r in text.sites(spark, write(tmp_path / "s3", ["1\t3\t4", ""])).collect()] == [("1", 2), ("1", 3)]
    assert [tuple(r) for r in text.sites(spark, write(tmp_path / "s5", ["1\t3\t0\tc"])).collect()] == [("1", 2, 0, 1)]
    assert [text.parse_region(x) for x in ("c", "c:", "c:5-", "c:-9", "c:5-9", "c:7")] == [("c", 0, None), ("c", 0, None), ("c", 4, None), ("c", 0, 9), ("c", 4, 9), ("c", 6, 7)]
    assert text.regions(spark, ["1:3-4"]).first()["stop"] == 4
    assert text.file_list("a\nb\n\n", 1) == ["a"]
    with pytest.raises(ValueError):
        text.file_list("a\r\nb")
    m = text.matrix(spark, write(tmp_path / "y", ["1 2", "-999 3"]), [1, 0]).orderBy("sample").collect()
    assert [tuple(r) for r in m] == [(0, 2.0, 1.0), (1, 3.0, None)]
    s, kinds = text.sample_file(spark, write(tmp_path / "x.sample", ["ID_1 ID_2 missing pheno1", "0 0 0 B", "a a 0 1", "b b 0 NA"]))
    assert kinds["pheno1"] == "B" and [r["pheno1"] for r in s.orderBy("sample").collect()] == [1.0, None]
    assert text.saf_text(spark, write(tmp_path / "saf", ["1\t2\t-inf\t0\t-1.5"])).first()["saf"][0] == float("-inf")
    h = text.hapmap(spark, write(tmp_path / "h", ["10 A 0.3 + G", "10 A 0.4 + G", "12 A 0.3 - C", "40 A 0.01 + C"]), 0.05, 2).collect()
    assert sorted((r["pos"], r["freq"], r["allele1"]) for r in h) == [(10, 0.3, 0), (12, 0.3, 3)]


def test_binary(spark, tmp_path):
    a = np.arange(40, dtype=float)
    (tmp_path / "x.glf").write_bytes(gzip.compress(a.tobytes()))
    got = binary.glf(spark, str(tmp_path / "x.glf"), 2).orderBy("site", "sample").collect()
    assert len(got) == 4 and got[3]["gl"] == list(a[30:])
    three = binary.glf(spark, str(tmp_path / "x.glf"), 1, 3).orderBy("site").first()
    assert three["gl"][:2] == [0.0, 1.0] and three["gl"][4] == 2.0
    (tmp_path / "i").write_bytes(struct.pack("<10i", 3, 1, 2, 0, 0, 4, 0, 0, 0, 9))
    assert [tuple(r) for r in binary.icounts(spark, str(tmp_path / "i"), 1, 5).collect()] == [(3, 1, 2, 0, 0)]
    name, ops, seq, qual = b"r1\0", struct.pack("<I", 3 << 4), bytes([0x12, 0x40]), bytes([30, 255, 2])
    body = struct.pack("<iiBBHHHiiii", 0, 6, len(name), 60, 0, 1, 16, 3, -1, -1, 0) + name + ops + seq + qual + b"NMC\x01RGZgrp\0"
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))
    r = binary.bam(spark, str(tmp_path / "x.bam")).first()
    assert (r["qname"], r["flag"], r["chr"], r["pos"], r["cigar"], r["seq"], r["rg"], r["qual"][0]) == ("r1", 16, "c", 7, "3M", "ACG", "grp", "?")


def test_bgen(spark, tmp_path):
    probs = np.array([[255, 0], [51, 102]], np.uint8)
    body = struct.pack("<IHBB", 2, 2, 2, 2) + bytes([2, 2]) + bytes([0, 8]) + probs.tobytes()
    packed = zlib.compress(body)
    head = struct.pack("<IIII", 20, 1, 2, 0) + struct.pack("<I", 1 | 2 << 2)
    head = struct.pack("<I", 20) + struct.pack("<III", 20, 1, 2) + b"bgen" + struct.pack("<I", 1 | 2 << 2)
    text16 = lambda s: struct.pack("<H", len(s)) + s
    variant = text16(b"v") + text16(b"rs") + text16(b"1") + struct.pack("<IH", 9, 2) + struct.pack("<I", 1) + b"A" + struct.pack("<I", 1) + b"G" + struct.pack("<I", len(packed) + 4) + struct.pack("<I", len(body)) + packed
    (tmp_path / "x.bgen").write_bytes(head + variant)
    r = binary.bgen(spark, str(tmp_path / "x.bgen")).first()
    assert (r["chr"], r["pos"], r["allele1"], r["allele2"]) == ("1", 8, "A", "G") and np.allclose(r["probs"], [[1, 0, 0], [0.2, 0.4, 0.4]])


def test_sinks(spark, tmp_path):
    post = spark.createDataFrame([("1", 4, 0, 2, 0, 0.9, 0.1, 0.0), ("1", 4, 0, 2, 1, 0.0, 0.0, 1.0), ("1", 2, 1, 3, 0, 0.2, 0.8, 0.0)], "chr string, pos int, major int, minor int, sample int, p0 double, p1 double, p2 double")
    out = str(tmp_path / "out")
    sinks.write_lines(sinks.beagle_lines(post, [0, 1]), out)
    back = {r["pos"]: r for r in text.beagle(spark, out).collect()}
    assert back[4]["probs"] == [[0.9, 0.1, 0.0], [0.0, 0.0, 1.0]] and back[2]["probs"][1] == [pytest.approx(0.333333)] * 3
    sinks.write_lines(sinks.vcf_lines(post, [0, 1]), out)
    gp = {(r["pos"], r["sample"]): r for r in text.vcf(spark, out, "GP").collect()}
    assert gp[4, 1]["p2"] == 1.0 and gp[2, 0]["major"] == 1
    calls = spark.createDataFrame([("1", 4, 0, 2, 0, 1), ("1", 4, 0, 2, 1, -1)], "chr string, pos int, major int, minor int, sample int, geno int")
    assert sinks.tped_lines(calls, [0, 1]).first()["value"] == "1 1_5 0 5 A G 0 0"
    assert sinks.bed_bytes(np.array([[0, 1, 2, -1, 0]])) == b"\x6c\x1b\x01" + bytes([0b01001011, 0b11])
    m = sinks.square(spark.createDataFrame([(0, 1, 0.5)], "i int, j int, ibs double"), "ibs").orderBy("i").collect()
    assert [tuple(r) for r in m] == [(0, None, 0.5), (1, 0.5, None)]
    f = spark.createDataFrame([("1", 4, 1, 0, 0.1, 3)], "chr string, pos int, major int, minor int, freq double, n int")
    sinks.write_tsv(sinks.mafs(f, "PPmaf"), out, "chromo", "position")
    assert spark.read.csv(out, sep="\t", header=True).first()["PPmaf"] == "0.100000"
    sinks.write_log(str(tmp_path / "log.json"), a=1)
