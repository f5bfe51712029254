"""Estimators that iterate over the whole data: parameters live on the driver, every round is one distributed sum."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lociforge.operators.estimators import Ragged, _lists, em_frequency, hwe_prior, log_likelihood


#: Numbers that tasks may send straight to the driver in one round of sums; beyond it they are added up on the executors first.
STRAIGHT = 2_000_000


def total_of(df: DataFrame, size: int, fill: Callable[[pa.RecordBatch, np.ndarray], None], tasks: int | None = None) -> np.ndarray:
    """The sum over all batches of a fixed-size array: one row a task, added up in two rounds.

    Where the number of tasks is known and their rows are small together, the first round is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(size)
        for b in batches:
            if b.num_rows:
                fill(b, t)
        yield pa.RecordBatch.from_arrays([_lists(t[None, :])], ["s"])

    sums = df.mapInArrow(run, "s array<double>")
    if tasks is not None and tasks * size <= STRAIGHT:
        got = sums.toArrow()["s"].combine_chunks()
        return np.asarray(got.flatten(), dtype=np.float64).reshape(-1, size).sum(axis=0)
    few = sums.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(32))).agg(F.collect_list("s").alias("s"))
    rows = few.select(F.reduce("s", F.array_repeat(F.lit(0.0), size), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("s")).collect()
    return np.sum([r["s"] for r in rows], axis=0) if rows else np.zeros(size)


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """The table kept over the rounds of an iteration, and its number of partitions."""
    kept = df.persist()
    return kept, kept.rdd.getNumPartitions()


def _padded(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Likelihoods (sites x n x 3) of a column of full arrays."""
    return np.asarray(b["l3"].flatten(), dtype=np.float64).reshape(b.num_rows, n, 3)


def full_sites(l3: DataFrame, samples: list[int]) -> DataFrame:
    """``chr, pos, l3`` with three likelihoods of every sample in the given order (equal ones where there is no information)."""
    rows = F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("int"), F.array("l0", "l1", "l2"))))
    flat = F.array(*[F.lit(1.0)] * 3)
    return l3.groupBy("chr", "pos").agg(rows.alias("m")).select("chr", "pos", F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(s)), flat) for s in samples))).alias("l3"))


def informative_sites(sites: DataFrame, n: int, min_maf: float = 0.05, min_ind: int = 0, min_lrt: float = 0.0, spread: float = 0.05) -> DataFrame:
    """Sites fit for ancestry estimates: enough samples whose likelihoods (scaled to sum 1) spread by more than ``spread``, and a
    frequency and likelihood ratio of being variable above their limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _padded(b, n)
            scaled = x / np.maximum(x.sum(axis=2, keepdims=True), 1e-300)
            tells = (scaled.max(axis=2) - scaled.min(axis=2) > spread).sum(axis=1)
            r = Ragged(x.ravel(), np.full(b.num_rows, n))
            f = em_frequency(r, 0.3)
            keep = (tells >= min_ind) & (np.minimum(f, 1 - f) >= min_maf)
            if min_lrt > 0:
                one, other = (log_likelihood(r, hwe_prior(np.full(b.num_rows, v))) for v in (0.0, 1.0))
                keep &= 2 * (log_likelihood(r, hwe_prior(f)) - np.maximum(one, other)) >= min_lrt
            yield b.filter(pa.array(keep))

    t = dict(sites.dtypes)
    return sites.select("chr", "pos", "l3").mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, l3 array<double>")


def admixture(sites: DataFrame, n: int, k: int, rounds: int = 300, tol: float = 1e-7, seed: int = 1, inner: int = 60) -> tuple[np.ndarray, DataFrame, float]:
    """Ancestry shares Q (samples x k), allele frequencies F as a table ``chr, pos, f``, and the log likelihood.

    ``sites`` have ``l3`` for all n samples (equal values where there is no information).  A site's frequencies depend on the other
    sites only through Q, so every round fits them anew inside its kernel (up to ``inner`` EM steps): one pass over one cached
    table, nothing written back.  Only Q and its sums (n x k numbers) cross the driver, where the rounds are accelerated by extrapolation along
    the last two; ``rounds`` counts passes, and the estimate is final when a round gains less than ``tol`` of the log likelihood.
    """
    t = dict(sites.dtypes)
    data, tasks = held(sites.select("chr", "pos", "l3"))

    def fitted(b: pa.RecordBatch, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        l3 = _padded(b, n)
        f = np.tile(np.clip((l3[:, :, 1] + 2 * l3[:, :, 2]).sum(axis=1) / (2 * l3.sum(axis=(1, 2))), 0.01, 0.99)[:, None], (1, k))

        def expected(l3: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = np.clip(f @ q.T, 1e-9, 1 - 1e-9)
            w = l3 * np.stack([(1 - h) ** 2, 2 * h * (1 - h), h**2], axis=2)
            s = np.maximum(w.sum(axis=2), 1e-300)
            g = (w[:, :, 1] + 2 * w[:, :, 2]) / s
            return g / h, (2 - g) / (1 - h), s

        going = np.arange(len(f))
        for _ in range(inner):
            a, c, _ = expected(l3[going], f[going])
            up, down = f[going] * (a @ q), (1 - f[going]) * (c @ q)
            new = np.clip(up / np.maximum(up + down, 1e-300), 1e-6, 1 - 1e-6)
            more = np.abs(new - f[going]).max(axis=1) > 1e-4
            f[going] = new
            going = going[more]
            if not len(going):
                break
        a, c, s = expected(l3, f)
        return f, a, c, float(np.log(s).sum())

    def step(q: np.ndarray) -> tuple[np.ndarray, float]:
        def fill(b: pa.RecordBatch, t: np.ndarray) -> None:
            f, a, c, lik = fitted(b, q)
            t[:-1] += (q * (a.T @ f + c.T @ (1 - f))).ravel()
            t[-1] += lik

        t = total_of(data, n * k + 1, fill, tasks)
        return _shares(t[:-1].reshape(n, k)), float(t[-1])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], _lists(fitted(b, q)[0])], ["chr", "pos", "f"])

    q, it = np.random.default_rng(seed).dirichlet(np.ones(k), n), 0
    lik, last = -np.inf, -np.inf
    while it < rounds:
        q1, lik = step(q)
        it += 1
        if abs(lik - last) <= tol * abs(lik):
            break
        last = lik
        q2, lik1 = step(q1)
        r, v = q1 - q, (q2 - q1) - (q1 - q)
        size = float((v * v).sum())
        it += 1
        if size < 1e-20:
            q = q2
            continue
        a = -max(1.0, math.sqrt(float((r * r).sum()) / size))
        leap = _shares(np.maximum(q - 2 * a * r + a * a * v, 1e-9))
        q3, lik3 = step(leap)
        it += 1
        q = q3 if lik3 >= lik1 else q2
    data.unpersist()
    return q, sites.select("chr", "pos", "l3").mapInArrow(table, f"chr {t['chr']}, pos {t['pos']}, f array<double>"), lik


def _shares(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300), 1e-9)
    return x / x.sum(axis=1, keepdims=True)


def genotype_spectrum(gl: DataFrame, rounds: int = 30) -> np.ndarray:
    """Frequencies of the ten genotypes of one sample (column ``gl``) by EM."""
    f = np.full(10, 0.1)
    gl, tasks = held(gl.select("gl"))
    try:
        for _ in range(rounds):
            now = f

            def fill(b: pa.RecordBatch, t: np.ndarray, now: np.ndarray = now) -> None:
                w = np.exp(np.asarray(b["gl"].flatten()).reshape(-1, 10)) * now
                t += (w / w.sum(axis=1, keepdims=True)).sum(axis=0)

            t = total_of(gl, 10, fill, tasks)
            f = t / max(t.sum(), 1e-300)
    finally:
        gl.unpersist()
    return f


def genotype_spectra_of_pairs(gl: DataFrame, samples: list[int], rounds: int = 100, tol: float = 1e-6) -> dict[tuple[int, int], np.ndarray]:
    """Joint genotype frequencies (10 x 10) of every pair of samples over the positions that both have, by EM.

    A position's samples stand in one row; every round is one pass in which each task adds up its 100 sums a pair.
    """
    m = F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("int"), "gl")))
    none = F.array_repeat(F.lit(float("nan")), 10)
    sites = gl.where(F.col("sample").isin(samples)).groupBy("chr", "pos").agg(m.alias("m")).select(F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(s)), none) for s in samples))).alias("g"))
    sites, tasks = held(sites)
    pairs = [(i, j) for i in range(len(samples)) for j in range(i + 1, len(samples))]
    f = np.full((len(pairs), 10, 10), 0.01)
    try:
        for _ in range(rounds):
            now = f

            def fill(b: pa.RecordBatch, t: np.ndarray, now: np.ndarray = now) -> None:
                g = np.exp(np.asarray(b["g"].flatten()).reshape(b.num_rows, len(samples), 10))
                there = ~np.isnan(g[:, :, 0])
                out = t.reshape(len(pairs), 10, 10)
                for k, (i, j) in enumerate(pairs):
                    both = there[:, i] & there[:, j]
                    x, y = g[both, i], g[both, j]
                    norm = ((x @ now[k]) * y).sum(axis=1)
                    out[k] += now[k] * ((x / norm[:, None]).T @ y)

            t = total_of(sites, 100 * len(pairs), fill, tasks).reshape(len(pairs), 10, 10)
            f = t / np.maximum(t.sum(axis=(1, 2), keepdims=True), 1e-300)
            if np.abs(f - now).max(initial=0) < tol:
                break
    finally:
        sites.unpersist()
    return {(samples[i], samples[j]): f[k] for k, (i, j) in enumerate(pairs)}


def error_rates(counts: DataFrame, rounds: int = 100, tol: float = 1e-7) -> np.ndarray:
    """Type-specific error rates (4 x 4, row true base) from counts of monomorphic-or-not sites, by EM over the unknown genotype.

    Every sample and position is one observation (n_a ... n_t); the ten genotypes have unknown frequencies, errors unknown rates.
    """
    cells = counts.select(*(F.col(c).cast("double") for c in ("n_a", "n_c", "n_g", "n_t"))).where("n_a + n_c + n_g + n_t > 0")
    # equal count vectors are one row with a weight: the table is as small as the number of different piles
    cells = cells.groupBy("n_a", "n_c", "n_g", "n_t").agg(F.count(F.lit(1)).cast("double").alias("w"))
    cells, tasks = held(cells)
    pairs = [(a, b) for a in range(4) for b in range(a, 4)]
    err = np.full((4, 4), 0.01) + np.eye(4) * 0.96
    freq = np.array([0.2 if a == b else 0.2 / 6 for a, b in pairs])
    try:
        for _ in range(rounds):
            now_e, now_f = err, freq

            def fill(b: pa.RecordBatch, t: np.ndarray, now_e: np.ndarray = now_e, now_f: np.ndarray = now_f) -> None:
                n = np.stack([np.asarray(b[c]) for c in ("n_a", "n_c", "n_g", "n_t")], axis=1)
                w = np.asarray(b["w"])
                mix = np.array([(now_e[a] + now_e[c]) / 2 for a, c in pairs])
                lp = n @ np.log(mix).T + np.log(np.maximum(now_f, 1e-300))
                top = lp.max(axis=1, keepdims=True)
                post = np.exp(lp - top)
                post *= (w / post.sum(axis=1))[:, None]
                t[16:26] += post.sum(axis=0)
                for g, (a, c) in enumerate(pairs):
                    seen = post[:, g] @ n
                    for x in (a, c):
                        t[4 * x : 4 * x + 4] += seen * now_e[x] / (now_e[a] + now_e[c])

            t = total_of(cells, 26, fill, tasks)
            e = t[:16].reshape(4, 4)
            err = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
            err = np.maximum(err, 1e-9)
            freq = t[16:] / max(t[16:].sum(), 1e-300)
            if np.abs(err - now_e).max() < tol:
                break
    finally:
        cells.unpersist()
    return err


def brent_minimum(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-8) -> float:
    """Minimum of a function of one variable by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def contamination_sites(counts: DataFrame, snps: DataFrame, flank: int = 4) -> DataFrame:
    """Counts around known SNPs (table pos, freq): one row a SNP with ``freq, depth, other`` at it and ``flank_depth, flank_other`` beside it.

    Only SNPs with data at all 2 * flank + 1 positions count; ``other`` are the bases that aren't the commonest one of the position.
    """
    d = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    c = counts.where(d > 0).select("pos", d.alias("d"), (d - F.greatest("n_a", "n_c", "n_g", "n_t")).alias("o"))
    near = snps.select(F.col("pos").alias("snp"), "freq", F.explode(F.sequence(F.col("pos") - flank, F.col("pos") + flank)).alias("pos"))
    j = near.join(c, "pos")
    at = F.col("pos") == F.col("snp")
    g = j.groupBy("snp", "freq").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(at, F.col("d"))).alias("depth"), F.sum(F.when(at, F.col("o"))).alias("other"), F.sum(F.when(~at, F.col("d"))).alias("flank_depth"), F.sum(F.when(~at, F.col("o"))).alias("flank_other"))
    return g.where(F.col("k") == 2 * flank + 1).drop("k")


def contamination_moments(sites: DataFrame) -> DataFrame:
    """Moment estimate with its jackknife error: ``eps, estimate, se, n_sites``; leaving one SNP out is total minus row."""
    x = sites.select((F.col("other") / F.col("depth")).alias("r"), "freq", F.col("flank_depth").alias("fd"), F.col("flank_other").alias("fo"))
    total = x.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), F.sum("freq").alias("sf"), F.sum("fd").alias("sd"), F.sum("fo").alias("so")).first()
    s = x.withColumns({k: F.lit(v).cast("double") for k, v in total.asDict().items()})  # five numbers cross the driver

    def estimate(r: Column, f: Column, n: Column, eps: Column) -> Column:
        return (r / n - eps) / F.nullif(f / n * (1 - 4 * eps / 3), F.lit(0.0))

    eps = F.col("so") / F.nullif(F.col("sd"), F.lit(0))
    left = (F.col("so") - F.col("fo")) / F.nullif(F.col("sd") - F.col("fd"), F.lit(0))
    s = s.withColumns({"eps": eps, "all": estimate(F.col("sr"), F.col("sf"), F.col("n"), eps), "one": estimate(F.col("sr") - F.col("r"), F.col("sf") - F.col("freq"), F.col("n") - 1, left)})
    return s.agg(F.first("eps").alias("eps"), F.first("all").alias("estimate"), (F.sqrt(F.var_pop("one") * (F.first("n") - 1))).alias("se"), F.first("n").cast("bigint").alias("n_sites"))


def contamination_likelihood(sites: DataFrame) -> float:
    """Maximum-likelihood contamination: the binomial chance of another base at a SNP is x f (1 - 4 eps / 3) + eps.

    Equal SNPs (depth, other, freq) are one row with a weight.
    """
    eps_row = sites.agg((F.sum("flank_other") / F.sum("flank_depth")).alias("e")).first()
    eps = float(eps_row["e"] or 0.0)
    kinds, tasks = held(sites.groupBy("depth", "other", "freq").agg(F.count(F.lit(1)).alias("w")))
    try:
        grid = np.linspace(1e-6, 0.5, 65)
        for _ in range(4):  # the grid closes in on the best value, one distributed pass each

            def fill(b: pa.RecordBatch, t: np.ndarray, grid: np.ndarray = grid) -> None:
                d, o, f, w = (np.asarray(b[c], dtype=float) for c in ("depth", "other", "freq", "w"))
                p = np.clip(grid[:, None] * f * (1 - 4 * eps / 3) + eps, 1e-12, 1 - 1e-12)
                t += (w * (o * np.log(p) + (d - o) * np.log1p(-p))).sum(axis=1)

            lik = total_of(kinds, len(grid), fill, tasks)
            k = int(np.argmax(lik))
            grid = np.linspace(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], len(grid))
        return float(grid[len(grid) // 2])
    finally:
        kinds.unpersist()


def heterozygosity(psmc: DataFrame, by: tuple[str, ...] = ("sample",), rounds: int = 60, tol: float = 1e-10) -> DataFrame:
    """``by..., rate``: maximum-likelihood share of heterozygous sites of each group, from the log likelihoods ``hom`` and ``het``.

    The log likelihood of a share x is concave, so Newton steps kept inside a shrinking bracket reach in a few passes the value that EM
    creeps up to.  What crosses the driver is one number a group (a sample).
    """
    spark = psmc.sparkSession
    t = psmc.select(*by, (F.exp(F.col("het") - F.col("hom")) - 1).alias("d")).persist()
    try:
        keys = t.select(*by).distinct()
        state = {tuple(r): (0.0, 1.0, 0.01) for r in keys.collect()}
        number = lambda name: StructType([*keys.schema.fields, StructField(name, DoubleType())])
        going = set(state)
        for _ in range(rounds):
            if not going:
                break
            now = spark.createDataFrame([(*k, state[k][2]) for k in going], number("x"))
            w = F.col("d") / (1 + F.col("x") * F.col("d"))
            for r in t.join(F.broadcast(now), list(by)).groupBy(*by).agg(F.sum(w), F.sum(w * w)).collect():
                k, slope, curve = tuple(r[: len(by)]), float(r[-2]), float(r[-1])
                lo, hi, x = state[k]
                lo, hi = (x, hi) if slope > 0 else (lo, x)
                new = x + slope / curve if curve > 0 else x
                if not lo < new < hi:
                    new = (lo + hi) / 2
                state[k] = (lo, hi, new)
                if abs(new - x) < tol or not slope:
                    going.discard(k)
        return spark.createDataFrame([(*k, min(max(x, 0.0), 1.0)) for k, (_, _, x) in state.items()], number("rate"))
    finally:
        t.unpersist()


def heterozygous_windows(psmc: DataFrame, rates: DataFrame, by: tuple[str, ...] = ("sample",), size: int = 100, cutoff: float = 0.9) -> DataFrame:
    """``by..., chr, win, n_sites, is_het``: windows that hold a site more likely than cutoff to be heterozygous at its group's rate."""
    h = F.exp("het") * F.col("rate")
    p = h / (h + F.exp("hom") * (1 - F.col("rate")))
    joined = psmc.join(rates, list(by))
    return joined.groupBy(*by, "chr", F.floor(F.col("pos") / size).alias("win")).agg(F.count(F.lit(1)).alias("n_sites"), F.coalesce(F.bool_or(p > cutoff), F.lit(False)).alias("is_het"))
