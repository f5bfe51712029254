"""Per-position quality statistics: strand bias and rank tests between the reads of the two alleles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.operators.estimators import chi2_tail

SITE = ["chr", "pos"]


def fisher_two_tail(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p-value of a 2 x 2 table: tables no likelier than the given one."""
    row, col, n = a + b, a + c, a + b + c + d
    lg = math.lgamma

    def logp(x: int) -> float:
        return lg(row + 1) - lg(x + 1) - lg(row - x + 1) + lg(n - row + 1) - lg(col - x + 1) - lg(n - row - col + x + 1) - lg(n + 1) + lg(col + 1) + lg(n - col + 1)

    mine = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := logp(x)) <= mine + 1e-7))


def allele_reads(reads: DataFrame, alleles: DataFrame) -> DataFrame:
    """Reads that show the major or the minor allele of their position, with ``is_minor``."""
    j = reads.join(alleles.select(*SITE, "major", "minor"), SITE)
    return j.where((F.col("base") == F.col("major")) | (F.col("base") == F.col("minor"))).withColumn("is_minor", F.col("base") != F.col("major"))


def rank_tests(x: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Normal deviates of the rank-sum tests of several values between minor and major reads, all from one histogram and its running sums."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), v.cast("bigint").alias("v")) for k, v in values.items()))).alias("k")
    h = x.select(*SITE, "is_minor", kinds).groupBy(*SITE, F.col("k.stat").alias("stat"), F.col("k.v").alias("v")).agg(F.count_if(~F.col("is_minor")).alias("m1"), F.count_if("is_minor").alias("m2"))
    w = Window.partitionBy(*SITE, "stat").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"b1": F.coalesce(F.sum("m1").over(w), F.lit(0)), "b2": F.coalesce(F.sum("m2").over(w), F.lit(0))})
    g = h.groupBy(*SITE, "stat").agg(F.sum(F.col("m2") * (F.col("m1") / 2 + F.col("b1"))).alias("u1"), F.sum(F.col("m1") * (F.col("m2") / 2 + F.col("b2"))).alias("u2"), F.sum("m1").alias("n1"), F.sum("m2").alias("n2"))
    sd = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    z = (F.least("u1", "u2") - F.col("n1") * F.col("n2") / 2.0) / F.nullif(sd, F.lit(0.0))
    return g.groupBy(*SITE).agg(*(F.max(F.when(F.col("stat") == k, z)).alias(k) for k in values))


def statistic_filter(stats: DataFrame, min_strand_p: float = 0.0, min_het_p: float = 0.0, max_z: float | None = None, max_sb1: float | None = None) -> DataFrame:
    """Positions whose quality statistics raise no doubt: exact strand test and test of heterozygotes above their levels, deviates of the rank
    tests and the strand contrast within limits; a statistic that a position hasn't got doesn't count against it."""
    ok = F.lit(True)
    if min_strand_p > 0:
        ok &= F.coalesce(F.col("sb3_p") >= min_strand_p, F.lit(True))
    if min_het_p > 0:
        ok &= F.coalesce(F.col("het_bias_p") >= min_het_p, F.lit(True))
    if max_z is not None:
        for c in ("z_qs", "z_mapq", "z_edge"):
            ok &= F.coalesce(F.abs(c) <= max_z, F.lit(True))
    if max_sb1 is not None:
        ok &= F.coalesce(F.abs("sb1") <= max_sb1, F.lit(True))
    return stats.where(ok)


def site_statistics(reads: DataFrame, alleles: DataFrame, hets: DataFrame | None = None) -> DataFrame:
    """Strand counts of both alleles, three strand-bias statistics, and deviates for base quality, mapping quality and read edge.

    ``n_major_fwd`` ... are the counts; sb1 contrasts the minor shares of the strands, sb2 their odds, ``sb3_p`` is the exact test.  With
    ``hets`` (chr, pos, sample called heterozygous) also the chi-square test ``het_bias_p`` of equal shares among their reads.
    """
    x = allele_reads(reads, alleles)
    rev = F.col("is_rev")
    names = {"n_major_fwd": ~F.col("is_minor") & ~rev, "n_minor_fwd": F.col("is_minor") & ~rev, "n_major_rev": ~F.col("is_minor") & rev, "n_minor_rev": F.col("is_minor") & rev}
    s = x.groupBy(*SITE).agg(*(F.count_if(c).alias(k) for k, c in names.items()))
    a, b, c, d = (F.col(k).cast("double") for k in names)
    frac = lambda p, q: p / F.nullif(p + q, F.lit(0.0))
    total = a + b + c + d
    sb1 = (frac(b, a) - frac(d, c)) / F.nullif((b + d) / total, F.lit(0.0))
    share = F.nullif((a + c) / total, F.lit(0.0))
    sb2 = F.greatest(frac(b, a) * frac(c, d) / share, frac(d, c) * frac(a, b) / share)
    s = s.withColumns({"sb1": sb1, "sb2": sb2})
    kinds = list(names)
    cols = [*SITE, *kinds, "sb1", "sb2"]

    def fisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = [t[k].to_pylist() for k in kinds]
            p = [fisher_two_tail(*x) for x in zip(*n)]
            yield pa.RecordBatch.from_arrays([*(t[c] for c in cols), pa.array(p, pa.float64())], [*cols, "sb3_p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.select(*cols).schema)
    out = s.select(*cols).mapInArrow(fisher, schema + ", sb3_p double")
    out = out.join(rank_tests(x, {"z_qs": F.col("qs"), "z_mapq": F.col("mapq"), "z_edge": F.least("posi", "isop")}), SITE)
    if hets is not None:
        h = x.join(hets.select(*SITE, "sample"), [*SITE, "sample"]).groupBy(*SITE).agg(F.count_if("is_minor").alias("m"), F.count(F.lit(1)).alias("n"))

        def bias(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                m, n = np.asarray(t["m"], dtype=float), np.asarray(t["n"], dtype=float)
                yield pa.RecordBatch.from_arrays([t["chr"], t["pos"], pa.array(chi2_tail((2 * m - n) ** 2 / n))], [*SITE, "het_bias_p"])

        t = dict(h.dtypes)
        out = out.join(h.mapInArrow(bias, f"chr {t['chr']}, pos {t['pos']}, het_bias_p double"), SITE, "left")
    return out
