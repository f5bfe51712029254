"""Order-dependent likelihood models and site models over all four alleles, as Arrow kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import GENOTYPES, genotype
from lociforge.operators.estimators import Ragged, Rows, _flat, _lists, chi2_tail, em_frequency, hwe_prior, log_factorials, log_likelihood, log_saf, saf_matrix

SITE = ["chr", "pos"]
#: Fixed values of the published dependent-error model: dependency of errors and floor of their independence.
DEPENDENCY, FLOOR = 0.17, 0.03


@lru_cache(maxsize=4096)
def _tail_ratio(q: int, n: int) -> np.ndarray:
    """For k = 0 ... n the log10 odds (x -10) of more than k errors against at least k among n bases of quality q."""
    e = 10 ** (-q / 10)
    k = np.arange(n + 1)
    lg = log_factorials(n)
    logs = lg[n] - lg[k] - lg[n - k] + k * math.log(e) + (n - k) * math.log1p(-e)
    tail = np.logaddexp.accumulate(logs[::-1])[::-1]
    return np.r_[-10 / math.log(10) * np.diff(tail), np.inf]


def _running(*keys: np.ndarray) -> np.ndarray:
    """How many earlier rows have the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def dependent_errors(base: np.ndarray, q: np.ndarray, rev: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log likelihoods (piles x 10) of piles laid end to end: errors of one base on one strand lose weight as they repeat, the best
    bases first."""
    pile = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((-base, ~rev.astype(bool), -q, pile))
    pile, base, q, rev = pile[order], base[order], q[order], rev[order].astype(bool)
    weight = (1 - DEPENDENCY) ** _running(pile, base, rev) * (1 - FLOOR) + FLOOR
    seen = _running(pile, base)
    n = sizes[pile]
    cost = np.zeros(len(base))
    key = q.astype(np.int64) * (int(sizes.max(initial=0)) + 1) + n
    by = np.argsort(key, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(key[by])) + 1) if len(by) else ():
        cost[part] = _tail_ratio(int(q[part[0]]), int(n[part[0]]))[seen[part]]
    cell = pile * 4 + base
    count = np.bincount(cell, minlength=4 * len(sizes)).reshape(-1, 4)
    total = np.bincount(cell, weight * cost, minlength=4 * len(sizes)).reshape(-1, 4)
    lg = log_factorials(int(sizes.max(initial=0)))
    out = np.empty((len(sizes), 10))
    for g, (a, c) in enumerate(GENOTYPES):
        # the same odds for bases that neither allele explains, at their dependency-corrected quality
        x = total.sum(axis=1) - total[:, a] - (total[:, c] if a != c else 0)
        if a != c:
            m = count[:, a] + count[:, c]
            x = x - 10 / math.log(10) * (lg[m] - lg[count[:, a]] - lg[count[:, c]] - m * math.log(2))
        out[:, g] = -np.maximum(x, 0) * math.log(10) / 10
    return out - out.max(axis=1, keepdims=True)


def gl_dependent(reads: DataFrame, min_q: int = 13, trim: int = 0, most: int | None = None, seed: int = 1) -> DataFrame:
    """``chr, pos, sample, gl`` of the dependent-error model; qualities are capped by mapping quality and kept within 4 to 63.

    All bases of a pile count.  ``most`` takes a random subset (by a hash of position, sample, read order and seed) of so many bases of a
    larger pile instead, as tools with a fixed buffer do; the order of equal bases doesn't matter.
    """
    r = reads.where((F.col("qs") >= min_q) & (F.col("posi") >= trim) & (F.col("isop") >= trim) & F.col("base").between(0, 3))
    q = F.greatest(F.lit(4), F.least(F.lit(63), F.col("qs"), F.col("mapq")))
    cell = F.struct(q.cast("int").alias("q"), F.col("is_rev").alias("rev"), F.col("base").cast("int").alias("base"))
    if most is not None:
        draw = F.xxhash64(*SITE, "sample", "ord", F.lit(seed))
        r = r.withColumn("__k", F.row_number().over(Window.partitionBy(*SITE, "sample").orderBy(draw, "ord"))).where(F.col("__k") <= most)
    g = r.groupBy(*SITE, "sample").agg(F.collect_list(cell).alias("r"))
    g = g.select(*SITE, "sample", F.col("r.base").alias("base"), F.col("r.q").alias("q"), F.col("r.rev").alias("rev"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gl = dependent_errors(*(np.asarray(b[c].flatten()) for c in ("base", "q")), np.asarray(b["rev"].flatten().cast(pa.int8())), np.asarray(pc.list_value_length(b["base"])))
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], b["sample"], _lists(gl)], [*SITE, "sample", "gl"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, sample {t['sample']}, gl array<double>")


def calibration(reads: DataFrame) -> DataFrame:
    """Share of each observed base by quality, cycle and reference base, with one pseudo-count: the table of the calibrated model."""
    r = reads.where("base between 0 and 3 and ref between 0 and 3")
    cycle = F.when(F.col("is_rev"), F.col("isop")).otherwise(F.col("posi"))
    g = r.groupBy("qs", cycle.alias("cycle"), "ref").agg(*(F.count_if(F.col("base") == b).alias(f"n{b}") for b in range(4)))
    total = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") + 4
    return g.select("qs", "cycle", "ref", *(((F.col(f"n{b}") + 1) / total).alias(f"p{b}") for b in range(4)))


def gl_calibrated(reads: DataFrame, table: DataFrame) -> DataFrame:
    """``chr, pos, sample, gl`` with the base probabilities of ``calibration`` in place of the stated qualities."""
    cycle = F.when(F.col("is_rev"), F.col("isop")).otherwise(F.col("posi"))
    wide = table.groupBy("qs", "cycle").agg(*(F.max(F.when(F.col("ref") == a, F.col(f"p{b}"))).alias(f"c{a}{b}") for a in range(4) for b in range(4)))
    j = reads.where("base between 0 and 3").withColumn("cycle", cycle).join(wide, ["qs", "cycle"])
    p = [F.coalesce(F.element_at(F.array(*(F.col(f"c{a}{b}") for b in range(4))), F.col("base") + 1), F.lit(0.25)) for a in range(4)]
    g = j.groupBy(*SITE, "sample").agg(*(F.sum(F.log((p[a] + p[c]) / 2)).alias(f"g{i}") for i, (a, c) in enumerate(GENOTYPES)))
    top = F.greatest(*(F.col(f"g{i}") for i in range(10)))
    return g.select(*SITE, "sample", F.array(*(F.col(f"g{i}") - top for i in range(10))).alias("gl"))


def outgroup_counts(reads: DataFrame, quality_step: int = 5) -> DataFrame:
    """Counts by place in the read, strand, quality bin, ancestral, reference and observed base: what the outgroup model is fitted to."""
    ok = F.col("base").between(0, 3) & F.col("anc").between(0, 3) & F.col("ref").between(0, 3)
    place = F.least("posi", "isop")
    return reads.where(ok).groupBy(place.alias("place"), (F.col("posi") <= F.col("isop")).alias("five_prime"), "is_rev", F.floor(F.col("qs") / quality_step).alias("qbin"), "anc", "ref", "base").agg(F.count(F.lit(1)).alias("n"))


def outgroup_rates(counts: DataFrame) -> DataFrame:
    """Error rates by stratum and true base, from sites where outgroup and reference agree: ``..., ref, base, rate``."""
    keys = ["place", "five_prime", "is_rev", "qbin", "ref"]
    same = counts.where("anc = ref").groupBy(*keys, "base").agg(F.sum("n").alias("n"))
    total = same.groupBy(*keys).agg(F.sum("n").alias("t"))
    return same.join(total, keys).select(*keys, "base", ((F.col("n") + 1) / (F.col("t") + 4)).alias("rate"))


def collected_gl(gl: DataFrame, major: DataFrame | None = None) -> DataFrame:
    """One row for each position with its informative samples' ten likelihoods as one flat array ``gls``."""
    rows = F.sort_array(F.collect_list(F.struct("sample", "gl")))
    g = gl.where(F.array_max("gl") - F.array_min("gl") > 1e-9).groupBy(*SITE).agg(rows.alias("r"))
    g = g.select(*SITE, F.size("r").alias("n"), F.flatten("r.gl").alias("gls"))
    return g if major is None else g.join(major.select(*SITE, "major", *(["minor"] if "minor" in major.columns else [])), SITE)


def unknown_minor(r: Ragged, gls: np.ndarray, major: np.ndarray, start: float = 0.4, rounds: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Frequency of all that isn't the major allele: the three possible minors weighted by their likelihood in every round."""
    row_major = major[r.site]
    parts = []
    for k in range(3):
        minor = np.array([[x for x in range(4) if x != m][k] for m in range(4)])[row_major]
        lut = np.array([[genotype(a, b) for b in range(4)] for a in range(4)])
        at = np.arange(len(gls))
        parts.append(np.exp(np.stack([gls[at, lut[row_major, row_major]], gls[at, lut[row_major, minor]], gls[at, lut[minor, minor]]], axis=1)))
    p = np.full(len(r.sizes), start)
    for _ in range(rounds):
        prior = hwe_prior(p)
        w = [x * prior[r.site] for x in parts]
        lik = np.stack([r.sum(np.log(np.maximum(x.sum(axis=1), 1e-300))) for x in w], axis=1)
        weight = np.exp(lik - lik.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        e = sum(((x[:, 1] + 2 * x[:, 2]) / np.maximum(2 * x.sum(axis=1), 1e-300)) * weight[r.site, k] for k, x in enumerate(w))
        new = r.sum(e) / np.maximum(r.sizes, 1)
        if np.abs(new - p).max(initial=0) < tol:
            return new
        p = new
    return p


def four_frequencies(r: Ragged, gls: np.ndarray, rounds: int = 100, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of all four alleles by EM over the ten genotypes, and the log likelihood."""
    lik = np.exp(gls)
    copies = np.zeros((10, 4))
    for i, (a, b) in enumerate(GENOTYPES):
        copies[i, a] += 0.5
        copies[i, b] += 0.5
    f = np.full((len(r.sizes), 4), 0.25)

    def prior(f: np.ndarray) -> np.ndarray:
        return np.stack([f[:, a] * f[:, b] * (1 if a == b else 2) for a, b in GENOTYPES], axis=1)

    for _ in range(rounds):
        w = lik * prior(f)[r.site]
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        new = r.sum(w @ copies) / np.maximum(r.sizes, 1)[:, None]
        moved = np.abs(new - f).max(initial=0)
        f = new
        if moved < tol:
            break
    return f, r.sum(np.log(np.maximum((lik * prior(f)[r.site]).sum(axis=1), 1e-300)))


def allele_models(sites: DataFrame, rounds: int = 100, tol: float = 1e-5) -> DataFrame:
    """Adds to positions with ``gls``, major and minor: ``unknown_em``, the frequencies f0 ... f3 with their log
    likelihood ``lik``, and ``tri_lrt`` and ``tri_p`` of a third allele."""
    names = [*SITE, "major", "minor", "n", "unknown_em", "f0", "f1", "f2", "f3", "tri_lrt", "tri_p", "lik"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, _ = _flat(b["gls"])
            gls, sizes = flat.reshape(-1, 10), np.asarray(b["n"])
            major, minor = np.asarray(b["major"]), np.asarray(b["minor"])
            lut = np.array([[genotype(x, y) for y in range(4)] for x in range(4)])
            site = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(gls))
            l3 = np.exp(np.stack([gls[at, lut[major, major][site]], gls[at, lut[major, minor][site]], gls[at, lut[minor, minor][site]]], axis=1))
            r = Ragged(l3.ravel(), sizes)
            f, lik4 = four_frequencies(r, gls, rounds, tol)
            p = em_frequency(r, rounds=rounds, tol=tol)
            lrt = np.maximum(2 * (lik4 - log_likelihood(r, hwe_prior(p))), 0)
            out = [unknown_minor(r, gls, major, rounds=rounds, tol=tol), *f.T, lrt, chi2_tail(lrt), lik4]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names[:5]), *(pa.array(np.ascontiguousarray(x)) for x in out)], names)

    t = dict(sites.dtypes)
    schema = f"chr {t['chr']}, pos {t['pos']}, major {t['major']}, minor {t['minor']}, n int, " + ", ".join(f"{x} double" for x in names[5:])
    return sites.select(*SITE, "major", "minor", "n", "gls").mapInArrow(run, schema)


def drop_triallelic(models: DataFrame, p: float = 1e-3) -> DataFrame:
    """Positions of ``allele_models`` without evidence of a third allele at the level p."""
    return models.where(F.col("tri_p") >= p)


def saf_any_minor(gl: DataFrame, major: DataFrame, n: int) -> DataFrame:
    """``chr, pos, saf`` with known ancestral allele: the likelihoods of all three possible minors added up."""
    sites = collected_gl(gl, major)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = np.array([[genotype(x, y) for y in range(4)] for x in range(4)])
        for b in batches:
            if not b.num_rows:
                continue
            flat, _ = _flat(b["gls"])
            sizes, major = np.asarray(b["n"]), np.asarray(b["major"])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            full = np.zeros((len(sizes), n, 10))
            site = np.repeat(np.arange(len(sizes)), sizes)
            full[site, np.arange(len(site)) - starts[site]] = flat.reshape(-1, 10)
            at = np.arange(len(sizes))
            total = None
            for k in range(3):
                minor = np.array([[x for x in range(4) if x != m][k] for m in range(4)])[major]
                logs = np.stack([full[at, :, lut[major, major]], full[at, :, lut[major, minor]], full[at, :, lut[minor, minor]]], axis=2)
                top = logs.max(axis=2, keepdims=True)
                s = log_saf(np.exp(logs - top)) + top[:, :, 0].sum(axis=1)[:, None]  # on one scale for all three minors
                total = s if total is None else np.logaddexp(total, s)
            total -= total.max(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], _lists(total)], [*SITE, "saf"])

    t = dict(sites.dtypes)
    return sites.where("major between 0 and 3").mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, saf array<double>")


def spectrum_posterior(sites: DataFrame, sfs: np.ndarray, n: int) -> DataFrame:
    """Genotype posteriors under a spectrum as the prior: ``chr, pos, k, p0, p1, p2`` for the k-th of n samples of ``l3``.

    A sample's prior comes from the others' allele-frequency likelihoods: P(g) sums over their counts j the spectrum at j + g, times the
    chance that g of these j + g copies are the sample's.
    """
    spectrum = np.asarray(sfs, float) / np.sum(sfs)
    weight = np.zeros((3, 2 * n - 1))
    for g in range(3):
        for j in range(2 * n - 1):
            ways = math.comb(2, g) * math.comb(2 * n - 2, j) / math.comb(2 * n, j + g)
            weight[g, j] = spectrum[j + g] * ways

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Ragged(*_flat(b["l3"]))
            full = np.ones((len(r.sizes), n, 3))
            full[r.site, np.arange(len(r.l)) - r.starts[r.site]] = r.l
            post = np.zeros_like(full)
            for k in range(n):
                rest = np.exp(saf_matrix(np.delete(full, k, axis=1))) if n > 1 else np.ones((len(full), 1))
                post[:, k] = full[:, k] * (rest @ weight.T)
            post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
            m = len(full)
            idx = pa.array(np.repeat(np.arange(m), n))
            flat = post.reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b["chr"].take(idx), b["pos"].take(idx), pa.array(np.tile(np.arange(n, dtype=np.int32), m)), *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3))], [*SITE, "k", "p0", "p1", "p2"])

    t = dict(sites.dtypes)
    return sites.select(*SITE, "l3").mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, k int, p0 double, p1 double, p2 double")


def heteroplasmy(reads: DataFrame, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """``chr, pos, sample, depth, f0 ... f3, lrt``: frequencies of the four bases within a sample by EM over its reads, against one base only.

    The update keeps the old frequencies as one pseudo-read, as in the established tool.
    """
    g = reads.where("base between 0 and 3").groupBy(*SITE, "sample").agg(F.collect_list(F.struct("base", "qs")).alias("r"))
    g = g.select(*SITE, "sample", F.col("r.base").alias("base"), F.col("r.qs").alias("qs"))
    names = [*SITE, "sample", "depth", "f0", "f1", "f2", "f3", "lrt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, qs = np.asarray(b["base"].flatten()), np.asarray(b["qs"].flatten(), dtype=float)
            sizes = np.asarray(pc.list_value_length(b["base"]))
            e = 10 ** (-qs / 10)
            lik = np.repeat((e / 3)[:, None], 4, axis=1)
            lik[np.arange(len(base)), base] = 1 - e
            r = Rows(lik, sizes)
            x = np.full((len(sizes), 4), 0.25)
            now = np.full(len(sizes), -np.inf)
            going, sub = np.arange(len(sizes)), r
            for _ in range(rounds):
                if not len(going):
                    break
                w = sub.l * x[going][sub.site]
                y = x[going] + sub.sum(w / w.sum(axis=1, keepdims=True))
                y /= y.sum(axis=1, keepdims=True)
                lk = sub.sum(np.log((sub.l * y[sub.site]).sum(axis=1)))
                more = np.abs(lk - now[going]) >= tol
                x[going], now[going] = y, lk
                going, sub = going[more], sub.part(more)
            alone = r.sum(np.log(np.maximum(lik, 1e-300))).max(axis=1, initial=-np.inf)
            out = [pa.array(np.ascontiguousarray(c)) for c in (*x.T, np.maximum(2 * (now - alone), 0.0))]
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], b["sample"], pa.array(sizes.astype(np.int32)), *out], names)

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, sample {t['sample']}, depth int, f0 double, f1 double, f2 double, f3 double, lrt double")


def likelihood_sites(gl: DataFrame) -> DataFrame:
    """``chr, pos, keep, major, minor, n, samples, l3``: best pair of alleles, oriented by the expected frequency, and the samples'
    likelihoods under it, in one pass.

    The same as ``best_pair(pair_scores(gl))``, ``three`` and ``collected`` in a row, without joining the likelihoods back: one shuffle
    brings a position's samples together, and a kernel does the rest.
    """
    rows = F.sort_array(F.collect_list(F.struct("sample", "gl")))
    g = gl.where(F.array_max("gl") - F.array_min("gl") > 1e-9).groupBy(*SITE).agg(rows.alias("r"))
    g = g.select(*SITE, F.col("r.sample").alias("samples"), F.flatten("r.gl").alias("gls"))
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    lut = np.array([[genotype(a, b) for b in range(4)] for a in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.array(pairs).T
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b["samples"]))
            gls = np.asarray(b["gls"].flatten()).reshape(-1, 10)
            r = Ragged(np.zeros(3 * len(gls)), sizes)
            score = np.stack([r.sum(np.logaddexp(np.logaddexp(gls[:, lut[a, a]], gls[:, lut[a, c]] + np.log(2)), gls[:, lut[c, c]])) for a, c in pairs], axis=1)
            k = np.round(score - 2 * np.log(2) * sizes[:, None], 9).argmax(axis=1)
            at, i, j = np.arange(len(gls)), first[k][r.site], second[k][r.site]
            logs = np.stack([gls[at, lut[i, i]], gls[at, lut[i, j]], gls[at, lut[j, j]]], axis=1)
            w = np.exp(logs - logs.max(axis=1, keepdims=True)) * [1, 2, 1]
            swap = np.round(r.sum((w[:, 1] + 2 * w[:, 2]) / (2 * w.sum(axis=1))) / sizes, 9) >= 0.5
            major, minor = np.where(swap, second[k], first[k]), np.where(swap, first[k], second[k])
            logs = np.where(swap[r.site, None], logs[:, ::-1], logs)
            tells = logs.max(axis=1) - logs.min(axis=1) > 1e-9
            l3 = np.exp(logs - logs.max(axis=1, keepdims=True))[tells]
            n = r.sum(tells.astype(float)).astype(np.int32)
            ends = np.r_[0, np.cumsum(n)].astype(np.int32)
            samples = pa.ListArray.from_arrays(pa.array(ends), b["samples"].flatten().filter(pa.array(tells)))
            flat = pa.ListArray.from_arrays(pa.array(3 * ends), pa.array(l3.ravel()))
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], pa.array(sizes.astype(np.int64)), pa.array(major.astype(np.int32)), pa.array(minor.astype(np.int32)), pa.array(n), samples, flat], [*SITE, "keep", "major", "minor", "n", "samples", "l3"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, keep bigint, major int, minor int, n int, samples {t['samples']}, l3 array<double>")


def long_likelihoods(sites: DataFrame, *more: str) -> DataFrame:
    """One row for each sample of positions with ``samples`` and ``l3``: ``chr, pos, major, minor, sample, l0, l1, l2`` and further columns."""
    cut = F.transform("samples", lambda s, i: F.struct(s.alias("sample"), *(F.get("l3", 3 * i + k).alias(f"l{k}") for k in range(3))))
    return sites.select(*SITE, "major", "minor", *more, F.explode(cut).alias("__r")).select(*SITE, "major", "minor", *more, "__r.*")


def gl_outgroup(reads: DataFrame, rates: DataFrame, quality_step: int = 5) -> DataFrame:
    """``chr, pos, sample, gl`` with the error rates of ``outgroup_rates``; strata without a rate use the stated quality."""
    keys = ["place", "five_prime", "is_rev", "qbin"]
    wide = rates.groupBy(*keys).agg(*(F.max(F.when((F.col("ref") == a) & (F.col("base") == b), F.col("rate"))).alias(f"r{a}{b}") for a in range(4) for b in range(4)))
    r = reads.where("base between 0 and 3").withColumns({"place": F.least("posi", "isop"), "five_prime": F.col("posi") <= F.col("isop"), "qbin": F.floor(F.col("qs") / quality_step)})
    j = r.join(wide, keys, "left")
    e = F.pow(F.lit(10.0), -F.col("qs") / 10.0)
    p = [F.coalesce(F.get(F.array(*(F.col(f"r{a}{b}") for b in range(4))), F.col("base")), F.when(F.col("base") == a, 1 - e).otherwise(e / 3)) for a in range(4)]
    j = j.select(*SITE, "sample", *(x.alias(f"q{a}") for a, x in enumerate(p)))
    g = j.groupBy(*SITE, "sample").agg(*(F.sum(F.log((F.col(f"q{a}") + F.col(f"q{c}")) / 2)).alias(f"g{i}") for i, (a, c) in enumerate(GENOTYPES)))
    top = F.greatest(*(F.col(f"g{i}") for i in range(10)))
    return g.select(*SITE, "sample", F.array(*(F.col(f"g{i}") - top for i in range(10))).alias("gl"))


def allele_set_calls(sites: DataFrame, theta: float = 1.1e-3) -> DataFrame:
    """``chr, pos, alleles, qual, n``: the likeliest set of one, two or three alleles of positions with ``gls`` and major (reference).

    A set's likelihood takes genotypes of its alleles under Hardy-Weinberg at the EM frequencies; each further allele costs the prior
    theta times the harmonic number of the chromosomes.  ``qual`` is the Phred-scaled chance that the position is as the reference.
    """
    sets = [s for k in (1, 2, 3) for s in combinations(range(4), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, _ = _flat(b["gls"])
            gls, sizes, ref = flat.reshape(-1, 10), np.asarray(b["n"]), np.asarray(b["major"])
            r = Ragged(np.zeros(3 * len(gls)), sizes)
            f, _ = four_frequencies(r, gls)
            extra = np.log(theta * np.array([sum(1 / i for i in range(1, max(2, 2 * int(m)))) for m in sizes]))
            score = []
            for s in sets:
                own = np.zeros(4)
                own[list(s)] = 1
                p = np.maximum(f * own, 1e-12 * own)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                prior = np.stack([p[:, a] * p[:, c] * (1 if a == c else 2) for a, c in GENOTYPES], axis=1)
                lik = r.sum(np.log(np.maximum((np.exp(gls) * prior[r.site]).sum(axis=1), 1e-300)))
                more = np.array([len(set(s) - {int(x)}) for x in ref])
                score.append(lik + more * extra)
            score = np.stack(score, axis=1)
            best = score.argmax(axis=1)
            total = np.logaddexp.reduce(score, axis=1)
            alone = score[np.arange(len(ref)), [sets.index((int(x),)) for x in ref]]
            qual = np.clip(-10 / math.log(10) * (alone - total), 0, 999)
            names = pa.array(["".join("ACGT"[x] for x in sets[k]) for k in best])
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], names, pa.array(qual), b["n"]], [*SITE, "alleles", "qual", "n"])

    t = dict(sites.dtypes)
    return sites.where("major between 0 and 3").select(*SITE, "major", "n", "gls").mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, alleles string, qual double, n int")
