"""Comparisons of samples over positions: identity by state, covariance, ABBA-BABA tests and their jackknife."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ["chr", "pos"]


def site_arrays(bases: DataFrame, n: int) -> DataFrame:
    """One row for each position with its samples' bases in order, -1 where there is none (samples 0 to n-1)."""
    m = F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("int"), F.col("base").cast("int"))))
    g = bases.where("base between 0 and 3").groupBy(*SITE).agg(m.alias("m"))
    return g.select(*SITE, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(-1))).alias("bases"))


def _matrices(b: pa.RecordBatch) -> np.ndarray:
    col = b["bases"]
    return np.asarray(col.flatten()).reshape(len(col), -1)


def ibs_matrix(bases: DataFrame, n: int, min_minor: int = 0, max_missing: int | None = None) -> DataFrame:
    """``i, j, n_both, n_diff, ibs`` of each pair of samples: positions where both have a base, and where these differ.

    Every task adds up sample-by-sample matrices with matrix products, so what is shuffled is a few matrices, not pairs of bases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, same = np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            x = _matrices(batch)
            each = np.stack([(x == b).sum(axis=1) for b in range(4)], axis=1)
            seen = each.sum(axis=1)
            keep = seen - each.max(axis=1, initial=0) >= min_minor
            if max_missing is not None:
                keep &= n - seen <= max_missing
            x = x[keep]
            has = (x >= 0).astype(float)
            both += has.T @ has
            for b in range(4):
                one = (x == b).astype(float)
                same += one.T @ one
        i, j = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j].astype(np.int64)), pa.array((both - same)[i, j].astype(np.int64))], ["i", "j", "n_both", "n_diff"])

    parts = site_arrays(bases, n).mapInArrow(run, "i int, j int, n_both bigint, n_diff bigint")
    g = parts.groupBy("i", "j").agg(F.sum("n_both").alias("n_both"), F.sum("n_diff").alias("n_diff"))
    return g.select("i", "j", "n_both", "n_diff", (F.col("n_diff") / F.nullif(F.col("n_both"), F.lit(0))).alias("ibs"))


def sampled_covariance(bases: DataFrame, alleles: DataFrame, n: int, min_freq: float = 0.001) -> DataFrame:
    """``i, j, cov, n_sites``: covariance of sampled alleles, standardised by the allele frequency of each position.

    A base counts 1 if it is the position's minor allele, 0 if the major one; others are missing.  Positions whose frequency is
    outside min_freq to 1 - min_freq are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cov, cnt = np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            x = _matrices(batch)
            major, minor = np.asarray(batch["major"])[:, None], np.asarray(batch["minor"])[:, None]
            has = ((x == major) | (x == minor)) & (x >= 0)
            k = has.sum(axis=1)
            f = ((x == minor) & has).sum(axis=1) / np.maximum(k, 1)
            keep = (k > 0) & (f >= min_freq) & (f <= 1 - min_freq)
            g = np.where(has, (x == minor) - f[:, None], 0.0)[keep] / np.sqrt(f * (1 - f))[keep, None]
            m = has[keep].astype(float)
            cov += g.T @ g
            cnt += m.T @ m
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cov[i, j]), pa.array(cnt[i, j].astype(np.int64))], ["i", "j", "s", "n"])

    parts = site_arrays(bases, n).join(alleles.select(*SITE, "major", "minor"), SITE).mapInArrow(run, "i int, j int, s double, n bigint")
    g = parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n_sites"))
    return g.select("i", "j", (F.col("s") / F.nullif(F.col("n_sites"), F.lit(0))).alias("cov"), "n_sites")


def posterior_covariance(post: DataFrame, n: int, min_freq: float = 0.2, min_post: float = 0.95, min_called: int = 5) -> DataFrame:
    """``i, j, cov, n_sites`` of expected genotypes from posteriors p0, p1, p2 in long form with the site's ``freq``.

    Expected genotypes are centred on their mean over all n samples (one without information counts with its prior, 2 freq) and divided by
    sqrt(freq (1 - freq)).  A sample counts where its likeliest genotype has a posterior of at least ``min_post``; positions need
    ``min_called`` such samples and a frequency between min_freq and 1 - min_freq.
    """
    e = F.col("p1") + 2 * F.col("p2")
    sure = F.greatest("p0", "p1", "p2") >= min_post
    rows = F.map_from_entries(F.collect_list(F.when(sure, F.struct(F.col("sample").cast("int"), e.alias("e")))))
    mean = (F.sum(e) + (n - F.count(F.lit(1))) * 2 * F.first("freq")) / n
    sites = post.where(F.col("freq").between(min_freq, 1 - min_freq)).groupBy(*SITE).agg(rows.alias("m"), F.first("freq").alias("f"), mean.alias("a")).where(F.size("m") >= min_called)
    sites = sites.select("f", "a", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col("m"), i)).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cov, cnt = np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            col, f, a = batch["e"], np.asarray(batch["f"]), np.asarray(batch["a"])
            e = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(col), -1)
            has = ~np.isnan(e)
            g = np.where(has, e - a[:, None], 0.0) / np.sqrt(f * (1 - f))[:, None]
            cov += g.T @ g
            cnt += has.T.astype(float) @ has
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cov[i, j]), pa.array(cnt[i, j].astype(np.int64))], ["i", "j", "s", "n"])

    g = sites.mapInArrow(run, "i int, j int, s double, n bigint").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n_sites"))
    return g.select("i", "j", (F.col("s") / F.nullif(F.col("n_sites"), F.lit(0))).alias("cov"), "n_sites")


def abba_baba(bases: DataFrame, outgroup: DataFrame, n: int, block: int = 5_000_000, drop_transitions: bool = False) -> DataFrame:
    """``chr, block, h1, h2, h3, n_abba, n_baba`` for all h1 < h2 and h3 other than these that have a base at some position of the block.

    ``outgroup`` gives the ancestral base (chr, pos, anc).  ABBA: h2 and h3 share a base that h1 and the outgroup haven't; BABA: h1 and h3
    do.  With drop_transitions positions where the outgroup and h3 differ by a transition count for nothing.
    """
    combos = np.array([(a, b, c) for c in range(n) for a, b in combinations([x for x in range(n) if x != c], 2)])
    sites = site_arrays(bases, n).join(outgroup.where("anc between 0 and 3").select(*SITE, "anc"), SITE)
    sites = sites.select("chr", F.floor((F.col("pos") + 1) / block).alias("block"), F.col("anc").cast("int").alias("anc"), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, anc = _matrices(batch), np.asarray(batch["anc"])
            where = np.stack([np.asarray(batch["chr"]), np.asarray(batch["block"])], axis=1)
            out = []
            for key in np.unique(where, axis=0):
                own = (where == key).all(axis=1)
                y, a = x[own], anc[own][:, None]
                for lo in range(0, len(combos), 512):
                    c = combos[lo : lo + 512]
                    h1, h2, h3 = y[:, c[:, 0]], y[:, c[:, 1]], y[:, c[:, 2]]
                    there = (h1 >= 0) & (h2 >= 0) & (h3 >= 0)
                    ok = there & (h3 != a)
                    if drop_transitions:
                        ok &= abs(h3 - a) != 2
                    abba, baba = ((h2 == h3) & (h1 == a) & ok).sum(axis=0), ((h1 == h3) & (h2 == a) & ok).sum(axis=0)
                    out += [(int(key[0]), int(key[1]), *map(int, k), int(p), int(q)) for k, p, q, seen in zip(c, abba, baba, there.any(axis=0)) if seen]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], ["chr", "block", "h1", "h2", "h3", "n_abba", "n_baba"])

    parts = sites.mapInArrow(run, "chr bigint, block bigint, h1 int, h2 int, h3 int, n_abba bigint, n_baba bigint")
    return parts.groupBy("chr", "block", "h1", "h2", "h3").agg(F.sum("n_abba").alias("n_abba"), F.sum("n_baba").alias("n_baba"))


def population_frequencies(counts: DataFrame, populations: DataFrame) -> DataFrame:
    """``chr, pos, pop, f0 ... f3``: base shares of each population (table sample, pop), samples weighted by 2n / (n + 1)."""
    j = counts.join(populations.select("sample", "pop"), "sample")
    d = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    w = 2.0 * d / (d + 1)
    j = j.where(d > 0)
    total = F.sum(w)
    return j.groupBy(*SITE, "pop").agg(*((F.sum(w * F.col(c) / d) / total).alias(f"f{i}") for i, c in enumerate(("n_a", "n_c", "n_g", "n_t"))))


def abba_baba_populations(freqs: DataFrame, combos: list[tuple[int, int, int, int]], block: int = 5_000_000) -> DataFrame:
    """``chr, block, h1, h2, h3, h4, numer, denom, n_sites`` of each combination of populations: summed ABBA - BABA and ABBA + BABA."""
    pops = sorted({p for c in combos for p in c})
    packed = F.map_from_entries(F.collect_list(F.struct(F.col("pop").cast("int"), F.array("f0", "f1", "f2", "f3"))))
    g = freqs.where(F.col("pop").isin(pops)).groupBy(*SITE).agg(packed.alias("m"))
    h = [F.col(f"c.h{i}") for i in (1, 2, 3, 4)]
    each = F.explode(F.array(*(F.struct(*(F.lit(p).alias(f"h{i + 1}") for i, p in enumerate(c))) for c in combos))).alias("c")
    s = g.select("chr", F.floor((F.col("pos") + 1) / block).alias("block"), "m", each).select("chr", "block", *(x.alias(f"h{i + 1}") for i, x in enumerate(h)), *(F.try_element_at("m", x).alias(f"q{i + 1}") for i, x in enumerate(h)))
    s = s.where("q1 is not null and q2 is not null and q3 is not null and q4 is not null")

    def dot(*names: str) -> Column:
        out = F.lit(0.0)
        for b in range(4):
            x = F.lit(1.0)
            for c in names:
                x = x * F.element_at(c, b + 1)
            out = out + x
        return out

    # sum over i != j of x(i) y(j) = (sum x)(sum y) - sum x y
    abba = dot("q1", "q4") * dot("q2", "q3") - dot("q1", "q4", "q2", "q3")
    baba = dot("q2", "q4") * dot("q1", "q3") - dot("q1", "q4", "q2", "q3")
    return s.groupBy("chr", "block", "h1", "h2", "h3", "h4").agg(F.sum(abba - baba).alias("numer"), F.sum(abba + baba).alias("denom"), F.count(F.lit(1)).alias("n_sites"))


def jackknife(blocks: DataFrame, by: list[str], numer: Column, denom: Column) -> DataFrame:
    """Ratio of sums with its delete-one-block jackknife: ``by..., d, se, z, n_blocks``.

    The ratio without a block is total minus the block, so one window replaces the loop over blocks.
    """
    w = Window.partitionBy(*by)
    x = blocks.select(*by, numer.cast("double").alias("a"), denom.cast("double").alias("b")).withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w), "k": F.count(F.lit(1)).over(w)})
    x = x.where("tb <> 0").withColumn("left", (F.col("ta") - F.col("a")) / F.nullif(F.col("tb") - F.col("b"), F.lit(0.0)))
    g = x.groupBy(*by).agg((F.first("ta") / F.first("tb")).alias("d"), F.var_pop("left").alias("v"), F.first("k").alias("n_blocks"))
    se = F.sqrt(F.col("v") * (F.col("n_blocks") - 1))
    return g.select(*by, "d", se.alias("se"), (F.col("d") / F.nullif(se, F.lit(0.0))).alias("z"), "n_blocks")
