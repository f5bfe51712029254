import math

import pytest

from lociforge.functions.genotypes import GENOTYPES
from lociforge.sources import formats, tables
from lociforge.sources.sinks import write_lines, write_tsv


def tsv(spark, path):
    return [tuple(r) for r in spark.read.csv(path, sep="\t", header=True).collect()]


def test_round_trips(spark, tmp_path):
    out = str(tmp_path / "x.thetas")
    t = spark.createDataFrame([("c_1", 4, 0.5, 0.25, 0.0, 1.0, 2.0), ("c_1", 2, 1.0, 1.0, 1.0, 1.0, 1.0)], "chr string, pos int, tw double, tp double, tf double, th double, tl double")
    write_tsv(tables.thetas(t), out, "Chromo", "Pos")
    back = {r["pos"]: r for r in formats.read(spark, out).collect()}
    assert back[4]["tw"] == pytest.approx(0.5, abs=1e-6) and back[4]["tf"] == 0 and set(back) == {2, 4}
    out = str(tmp_path / "x.fst")
    write_tsv(tables.fixation(spark.createDataFrame([("1", 9, 0.125, 0.5)], "chr string, pos int, a double, b double")), out, "chr", "pos")
    assert [tuple(r) for r in formats.read(spark, out).collect()] == [("1", 9, 0.125, 0.5)]
    out = str(tmp_path / "x.psmc")
    write_tsv(tables.psmc(spark.createDataFrame([("1", 9, 3, -1.5, -0.25)], "chr string, pos int, sample bigint, hom double, het double")), out, "chr", "pos")
    assert [tuple(r) for r in formats.read(spark, out).collect()] == [("1", 9, 3, -1.5, -0.25)]
    calls = spark.createDataFrame([("1", 9, 0, 0, 0), ("1", 9, 0, 2, 3), ("1", 8, 1, 1, 1)], "chr string, pos int, major int, sample int, base int")
    out = str(tmp_path / "x.haplo")
    write_tsv(tables.haploid(calls, [0, 1, 2]), out, "chr", "pos")
    assert sorted(tuple(r) for r in formats.read(spark, out).collect()) == [("1", 8, 1, 1, 1), ("1", 9, 0, 0, 0), ("1", 9, 0, 2, 3)]
    assert [tuple(r)[3:] for r in tables.haploid_tped(calls, [0, 1, 2]).orderBy("pos").collect()] == [(9, "0 0", "C C", "0 0"), (10, "A A", "0 0", "T T")]
    saf = spark.createDataFrame([("1", 6, [0.0, -1.5, float("-inf")])], "chr string, pos int, saf array<double>")
    out = str(tmp_path / "saf")
    write_lines(tables.allele_frequencies(saf).selectExpr("chr", "pos", "concat_ws('\t', chr, pos, value) as value"), out)
    assert formats.read(spark, out, "saf_text").first()["saf"] == [0.0, -1.5, float("-inf")]
    gl = spark.createDataFrame([("1", 6, 1, [-float(k) for k in range(10)])], "chr string, pos int, sample int, gl array<double>")
    line = tables.likelihoods(gl, [0, 1]).first()
    assert line["pos"] == 7 and line["value"].split("\t") == ["0.000000"] * 10 + [f"{-k:.6f}" if k else "-0.000000" for k in range(10)] and len(GENOTYPES) == 10


def test_genotype_text(spark):
    rows = [("1", 4, 0, 2, 0, 1, 0.9, 0.05, 0.9, 0.05), ("1", 4, 0, 2, 1, -1, 0.4, 0.4, 0.3, 0.3)]
    calls = spark.createDataFrame(rows, "chr string, pos int, major int, minor int, sample int, geno int, prob double, p0 double, p1 double, p2 double")
    r = tuple(tables.genotypes(calls, [0, 1, 5], letters=True, called=True).first())
    assert r == ("1", 5, "A", "G", "1", "AG", "0.900000", "-1", "NN", "0.400000", "-1", "NN", "0.333333")
    assert len(tables.genotypes(calls, [0], alleles=False, number=False, all_three=True).first()) == 5


def test_result_tables(spark, tmp_path):
    lrt = spark.createDataFrame([("1", 4, 10, 0.25, 1.5), ("1", 5, 10, 0.25, None)], "chr string, pos int, n int, freq double, lrt double")
    tables.write_associations({"y": lrt}, str(tmp_path / "a"))
    assert tsv(spark, str(tmp_path / "a" / "pheno=y")) == [("1", "5", "0.250000", "10", "1.500000"), ("1", "6", "0.250000", "10", "-999.000000")]
    hwe = spark.createDataFrame([("1", 4, 0, 1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)], "chr string, pos int, major int, minor int, hwe_freq double, freq double, f double, lrt double, p_value double, het_freq double")
    assert tuple(tables.hardy_weinberg(hwe).first())[:5] == ("1", 5, "A", "C", "0.100000")
    stats = spark.createDataFrame([("1", 4, 3, 1, 2, 0, 0.5, None, 0.25, 1.0, None, 0.0)], "chr string, pos int, n_major_fwd int, n_minor_fwd int, n_major_rev int, n_minor_rev int, sb1 double, sb2 double, sb3_p double, z_qs double, z_mapq double, z_edge double")
    assert tuple(tables.statistics(stats).first()) == ("1", 5, "3 1 2 0", "0.500000:nan:0.250000", "1.000000:nan:0.000000", "")
    ab = spark.createDataFrame([(1, 0, 0, 1, 2, 7, 3), (1, 1, 0, 2, 1, 4, 0)], "chr int, block int, h1 int, h2 int, h3 int, n_abba int, n_baba int")
    got = tables.abba_baba(ab, 200).orderBy("BLOCKstart").collect()
    assert [r["ABBA_0_1_2"] for r in got] == [7, 0] and [r["BLOCKend"] for r in got] == [200, 400]
    pat = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 5, [0.5] * 256, 2.0, 1.0)], "chr int, block int, h1 int, h2 int, h3 int, h4 int, n_sites int, patterns array<double>, n_abba double, n_baba double")
    r = tables.population_patterns(pat, 500).first()
    assert r["Numer"] == "1.000000" and r["0123"] == "0.500000" and len(r) == 266
    err = spark.createDataFrame([(None, 0, 1, 2, 3, 9), (None, 0, 4, None, 0, 2), (1, 0, 1, 2, 3, 9)], "chr int, sample int, anc int, ref int, base int, n int")
    row = tables.ancestral_errors(err).first()
    assert row[f"n{25 + 10 + 3}"] == 9 and row[f"n{100 + 20}"] == 2 and sum(row[1:]) == 11 and tables.ancestral_errors(err, True).count() == 1
    h = spark.createDataFrame([(0, 0, 5), (0, 3, 2)], "sample int, depth int, n_sites int")
    assert tables.depth_lines(h, 4).first()["value"] == "5\t0\t0\t2\t0"
    mm = spark.createDataFrame([(1, 2, 30, True, 0, 3, 8)], "posi int, isop int, qs int, is_rev boolean, ref int, base int, n int")
    assert tuple(tables.mismatches(mm).first()) == (1, 2, 30, 1, "A", "T", 8)
    assert tuple(tables.heteroplasmies(spark.createDataFrame([("1", 1, 0, 9, 0.5, 0.5, 0.0, 0.0, 3.25)], "chr string, pos int, sample int, depth int, f0 double, f1 double, f2 double, f3 double, lrt double")).first())[-1] == "3.250000"
    assert tuple(tables.depths(spark.createDataFrame([("1", 1, 9)], "chr string, pos int, depth int")).first()) == ("1", 2, 9)
    assert tables.counts(spark.createDataFrame([("1", 1, 9)], "chr string, pos int, n_a int")).columns == ["chr", "pos", "n_a"]
    assert tables.quality_scores(spark.createDataFrame([(30, 2)], "qs int, n int")).columns == ["qscore", "counts"]
    assert set(tables.SINKS) >= {"geno", "lrt", "hwe", "snpStat", "haplo", "saf", "psmc"} and math.isfinite(1)


def test_formats_by_name():
    assert [formats.format_of(p) for p in ("a/b.bam", "x.beagle.gz", "y.fa", "z.saf.thetas", "d.haplo/", "m.pileup.gz", "i.icnts.gz")] == ["bam", "beagle", "fasta", "thetas", "haplo", "mpileup", "icounts"]
    with pytest.raises(ValueError):
        formats.format_of("x.unknown")


def test_variant_and_plink_files(spark, tmp_path):
    from lociforge.sources import blocks, sinks, text

    rows = [("1", 4, 0, 2, 0, 1, 7, 0.1, 1.0, 0.01, 0.1, 0.9, 0.0), ("1", 4, 0, 2, 1, -1, 2, 1.0, 1.0, 1.0, 0.4, 0.3, 0.3)]
    calls = spark.createDataFrame(rows, "chr string, pos int, major int, minor int, sample int, geno int, depth int, l0 double, l1 double, l2 double, p0 double, p1 double, p2 double")
    line = sinks.vcf_full_lines(calls, [0, 1, 2]).first()["value"].split("\t")
    assert line[:5] == ["1", "5", ".", "A", "G"] and line[7] == "NS=2;DP=9;AF=0.450000"
    assert line[9] == "0/1:7:-1.000000,0.000000,-2.000000:10,0,20:0.100000,0.900000,0.000000" and line[10].startswith("./.:2:") and line[11] == "./.:.:.:.:."
    more = spark.createDataFrame([("1", p, s, (p + s) % 4 - 1) for p in range(9) for s in range(5)], "chr string, pos int, sample int, geno int")
    out = str(tmp_path / "bed")
    names = blocks.write_binary(sinks.bed_rows(more.coalesce(1), list(range(5))), out, "chr", "pos")
    body = b"".join((tmp_path / "bed" / n).read_bytes() for n in names)
    import numpy as np

    assert body == sinks.bed_bytes(np.array([[(p + s) % 4 - 1 for s in range(5)] for p in range(9)]))[3:]
    assert sinks.bim_lines(calls).first()["value"] == "1\t1_5\t0\t5\tG\tA"
    f = spark.createDataFrame([("1", 4, 1, 0, 2, 0.1, 0.2, 3)], "chr string, pos int, major int, minor int, ref int, freq double, phat double, n int")
    assert sinks.mafs(f, phat="phat").columns == ["chromo", "position", "major", "minor", "ref", "knownEM", "phat", "nInd"]
    (tmp_path / "r").write_text("1\t5\t9\n\n2 7 8\n1 3\n")
    assert sorted(tuple(r) for r in text.site_ranges(spark, str(tmp_path / "r")).collect()) == [("1", 4, 9), ("2", 6, 8)]
