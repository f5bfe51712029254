"""Estimators over the samples of a position, vectorised over many positions at once.

Input rows are positions with a flat array ``l3`` of genotype likelihoods, three for each sample.  Each Arrow batch is one ragged
numpy problem: all its positions iterate together and leave as they converge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, ROUNDS, TOLERANCE = 0.001, 100, 1e-5


def chi2_tail(x: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square distribution with one degree of freedom; 1 for negative values.

    The complementary error function comes from its Taylor series below 2.5 and from its continued fraction above.
    """
    z = np.sqrt(np.maximum(np.asarray(x, float), 0) / 2)
    near, far = np.minimum(z, 2.5), np.maximum(z, 2.5)
    term = total = near.copy()
    for k in range(1, 60):
        term = -term * near * near / k
        total = total + term / (2 * k + 1)
    fraction = far.copy()
    for k in range(60, 0, -1):
        fraction = far + k / 2 / fraction
    tail = np.where(z < 2.5, 1 - 2 / math.sqrt(math.pi) * total, np.exp(-far * far) / (fraction * math.sqrt(math.pi)))
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 1.0, tail))


@lru_cache(maxsize=64)
def _factorials(n: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]


def log_factorials(n: int) -> np.ndarray:
    """Logs of 0! ... n! (at least)."""
    return _factorials(1 << max(int(n) + 1, 16).bit_length())


def _lists(x: np.ndarray) -> pa.Array:
    """A two-dimensional array as a column of lists."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))


def chi2_threshold(p: float) -> float:
    """The value whose upper tail is p; values above 1 are taken as thresholds themselves."""
    if p > 1:
        return p
    lo, hi = 0.0, 1500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > p else (lo, mid)
    return lo


class Rows:
    """Rows of likelihoods with the group (position, or pile of bases) each belongs to."""

    def __init__(self, l: np.ndarray, sizes: np.ndarray) -> None:
        self.l = l
        self.sizes = sizes
        self.site = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Sums of each position's rows (zero for positions without any)."""
        out = np.zeros((len(self.sizes), *x.shape[1:]))
        some = self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(x, self.starts[some], axis=0)
        return out

    def part(self, keep: np.ndarray) -> Rows:
        return type(self)(self.l[keep[self.site]], self.sizes[keep])


class Ragged(Rows):
    """Rows of three likelihoods, from a flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        super().__init__(flat.reshape(-1, 3), sizes)


def _iterate(r: Ragged, x: np.ndarray, step: Callable[[Ragged, np.ndarray], np.ndarray], rounds: int, tol: float) -> np.ndarray:
    """Fixed-point iteration of each position until its parameters move by less than tol."""
    x = x.copy()
    active = np.flatnonzero(r.sizes > 0)
    sub = r.part(r.sizes > 0)
    for _ in range(rounds):
        if not len(active):
            break
        new = step(sub, x[active])
        moved = np.abs(new - x[active])
        going = (moved.max(axis=1) if moved.ndim > 1 else moved) >= tol
        x[active] = new
        if not going.all():
            active, sub = active[going], sub.part(going)
    return x


def hwe_prior(p: np.ndarray, f: np.ndarray | float = 0.0) -> np.ndarray:
    """Genotype probabilities at frequency p and inbreeding f."""
    shared = p * (1 - p) * f
    return np.stack([(1 - p) ** 2 + shared, 2 * p * (1 - p) - 2 * shared, p**2 + shared], axis=-1)


def em_frequency(r: Ragged, start: float = START, rounds: int = ROUNDS, tol: float = TOLERANCE, inbreeding: np.ndarray | None = None) -> np.ndarray:
    """Maximum-likelihood frequency of the minor allele; ``inbreeding`` holds a coefficient for each row of likelihoods."""

    def step(s: Ragged, p: np.ndarray) -> np.ndarray:
        f = inbreeding[s.row] if inbreeding is not None else 0.0
        w = s.l * hwe_prior(p[s.site], f)
        return s.sum((w[:, 1] + 2 * w[:, 2]) / np.maximum(2 * w.sum(axis=1), 1e-300)) / s.sizes

    if inbreeding is not None:
        r = _Numbered(r.l, r.sizes)
    return _iterate(r, np.where(r.sizes > 0, start, 0.0), step, rounds, tol)


class _Numbered(Rows):
    """Rows that remember their place in the original."""

    def __init__(self, l: np.ndarray, sizes: np.ndarray, row: np.ndarray | None = None) -> None:
        super().__init__(l, sizes)
        self.row = np.arange(len(self.l)) if row is None else row

    def part(self, keep: np.ndarray) -> _Numbered:
        rows = keep[self.site]
        return _Numbered(self.l[rows], self.sizes[keep], self.row[rows])


def log_likelihood(r: Ragged, prior: np.ndarray) -> np.ndarray:
    """Log likelihood of each position under its genotype probabilities."""
    return r.sum(np.log(np.maximum((r.l * prior[r.site]).sum(axis=1), 1e-300)))


def snp_lrt(r: Ragged, p: np.ndarray) -> np.ndarray:
    """Twice the gain in log likelihood of frequency p over a fixed site, at least 0."""
    return np.maximum(2 * (log_likelihood(r, hwe_prior(p)) - log_likelihood(r, hwe_prior(np.zeros_like(p)))), 0)


def em_hwe(r: Ragged, start: float = 0.1, rounds: int = 50, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and inbreeding coefficient; no genotype probability falls below 1e-4."""

    def step(s: Ragged, x: np.ndarray) -> np.ndarray:
        w = s.l * hwe_prior(x[:, 0], x[:, 1])[s.site]
        g = s.sum(w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)) / s.sizes[:, None]
        g = np.maximum(g, 1e-4)
        g /= g.sum(axis=1, keepdims=True)
        p = g[:, 1] / 2 + g[:, 2]
        return np.stack([p, 1 - g[:, 1] / (2 * p * (1 - p))], axis=1)

    p0 = em_frequency(r, start, rounds, tol)
    x = np.stack([np.clip(p0, 1e-4, 1 - 1e-4), np.full(len(p0), 0.05)], axis=1)
    x = _iterate(r, x, step, rounds, tol)
    return x[:, 0], x[:, 1]


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    return np.asarray(col.flatten().fill_null(0.0), dtype=np.float64), sizes // 3


def frequencies(sites: DataFrame, rounds: int = ROUNDS, tol: float = TOLERANCE, keep_samples: bool = False) -> DataFrame:
    """Adds to positions with ``l3``: ``freq`` (EM), ``lrt`` and ``p_value`` of being variable.  Positions without samples get 0.

    With ``keep_samples`` the likelihoods stay, so that posteriors need no join back to them.
    """
    cols = [c for c in sites.columns if keep_samples or c not in ("l3", "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Ragged(*_flat(b["l3"]))
            p = em_frequency(r, START, rounds, tol)
            lrt = snp_lrt(r, p)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), pa.array(p), pa.array(lrt), pa.array(chi2_tail(lrt))], [*cols, "freq", "lrt", "p_value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.select(*cols).schema)
    return sites.mapInArrow(run, schema + ", freq double, lrt double, p_value double")


def inbred_frequencies(l3: DataFrame, people: DataFrame, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """``chr, pos, major, minor, n, freq`` with each sample's inbreeding coefficient (table sample, inbreeding; 0 where there is none)."""
    rows = F.sort_array(F.collect_list(F.struct("sample", "l0", "l1", "l2", F.coalesce("inbreeding", F.lit(0.0)).alias("f"))))
    g = l3.join(people.select("sample", "inbreeding"), "sample", "left").groupBy("chr", "pos", "major", "minor").agg(rows.alias("r"))
    g = g.select("chr", "pos", "major", "minor", F.flatten(F.transform("r", lambda x: F.array(x["l0"], x["l1"], x["l2"]))).alias("l3"), F.col("r.f").alias("f"))
    names = ["chr", "pos", "major", "minor", "n", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Ragged(*_flat(b["l3"]))
            p = em_frequency(r, START, rounds, tol, np.asarray(b["f"].flatten(), dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names[:4]), pa.array(r.sizes.astype(np.int32)), pa.array(p)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.select(*names[:4]).schema)
    return g.mapInArrow(run, schema + ", n int, freq double")


def hwe_filter(hwe: DataFrame, min_p: float = 0.0, min_het: float = 0.0, max_het: float = 1.0, min_f: float | None = None, max_f: float | None = None) -> DataFrame:
    """Positions of ``hardy_weinberg`` in equilibrium (p-value above ``min_p``), with a frequency of heterozygotes and an inbreeding coefficient
    within limits."""
    ok = (F.greatest("lrt", F.lit(0.0)) < chi2_threshold(min_p) if min_p > 0 else F.lit(True)) & F.col("het_freq").between(min_het, max_het)
    if min_f is not None:
        ok &= F.col("f") >= min_f
    if max_f is not None:
        ok &= F.col("f") <= max_f
    return hwe.where(ok)


def hardy_weinberg(sites: DataFrame, rounds: int = 50, tol: float = 1e-5) -> DataFrame:
    """Adds ``hwe_freq`` (EM without inbreeding), ``freq`` and ``f`` (joint EM), ``lrt``, ``p_value`` and ``het_freq``."""
    cols = [c for c in sites.columns if c not in ("l3", "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Ragged(*_flat(b["l3"]))
            p0 = em_frequency(r, 0.1, rounds, tol)
            p, f = em_hwe(r, 0.1, rounds, tol)
            lrt = 2 * (log_likelihood(r, hwe_prior(p, f)) - log_likelihood(r, hwe_prior(p0)))
            out = [p0, p, f, lrt, chi2_tail(lrt), 2 * (1 - f) * p * (1 - p)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), *map(pa.array, out)], [*cols, "hwe_freq", "freq", "f", "lrt", "p_value", "het_freq"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.select(*cols).schema)
    return sites.mapInArrow(run, schema + ", hwe_freq double, freq double, f double, lrt double, p_value double, het_freq double")


def log_saf(l: np.ndarray) -> np.ndarray:
    """Log sample-allele-frequency likelihoods (sites x 2n+1) of likelihoods (sites x n x 3).

    The likelihood of j derived alleles is the sum over all genotype combinations that hold j, each weighted by its number of
    orderings, divided by the number of ways to choose j of 2n chromosomes.  Rows in which a bin underflows are added up in logs.
    """
    m, n, _ = l.shape
    h = np.zeros((m, 2 * n + 1))
    h[:, 0] = 1
    scale = np.zeros(m)
    for i in range(n):
        a, b, c = l[:, i, 0, None], 2 * l[:, i, 1, None], l[:, i, 2, None]
        new = h * a
        new[:, 1:] += h[:, :-1] * b
        new[:, 2:] += h[:, :-2] * c
        top = np.maximum(new.max(axis=1, keepdims=True), 1e-300)
        h = new / top
        scale += np.log(top[:, 0])
    f = log_factorials(2 * n)
    ways = f[2 * n] - f[: 2 * n + 1] - f[2 * n :: -1][: 2 * n + 1]
    with np.errstate(divide="ignore"):
        s = np.log(h) + scale[:, None]
        low = np.flatnonzero((h < 1e-290).any(axis=1))
        if len(low):
            logs = np.log(l[low]) + [0, math.log(2), 0]
            g = np.full((len(low), 2 * n + 1), -np.inf)
            g[:, 0] = 0
            for i in range(n):
                new = g + logs[:, i, 0, None]
                new[:, 1:] = np.logaddexp(new[:, 1:], g[:, :-1] + logs[:, i, 1, None])
                new[:, 2:] = np.logaddexp(new[:, 2:], g[:, :-2] + logs[:, i, 2, None])
                g = new
            s[low] = g
    return s - ways


def saf_matrix(l: np.ndarray) -> np.ndarray:
    """``log_saf`` relative to each row's largest value."""
    s = log_saf(l)
    with np.errstate(invalid="ignore"):
        return s - s.max(axis=1, keepdims=True)


def saf_matrix_haploid(l: np.ndarray) -> np.ndarray:
    """As ``saf_matrix`` for haploid samples: likelihoods (sites x n x 2) and n+1 bins."""
    m, n, _ = l.shape
    h = np.zeros((m, n + 1))
    h[:, 0] = 1
    for i in range(n):
        new = h * l[:, i, 0, None]
        new[:, 1:] += h[:, :-1] * l[:, i, 1, None]
        h = new / np.maximum(new.max(axis=1, keepdims=True), 1e-300)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(n + 1)])
    with np.errstate(divide="ignore"):
        s = np.log(h) - ways
    return s - s.max(axis=1, keepdims=True)


def allele_frequency_likelihoods(sites: DataFrame, n: int, haploid: bool = False) -> DataFrame:
    """``chr, pos, saf`` of positions with ``l3``: log likelihood of each number of minor alleles among n samples.

    Samples that aren't in ``l3`` have no information (equal likelihoods); positions where nobody has any are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Ragged(*_flat(b["l3"]))
            full = np.ones((len(r.sizes), n, 3))
            full[r.site, np.arange(len(r.l)) - r.starts[r.site]] = r.l
            some = r.sizes > 0
            if not some.any():
                continue
            s = saf_matrix_haploid(full[some][:, :, [0, 2]]) if haploid else saf_matrix(full[some])
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([b["chr"].filter(keep), b["pos"].filter(keep), _lists(s)], ["chr", "pos", "saf"])

    types = dict(sites.dtypes)
    return sites.select("chr", "pos", "l3").mapInArrow(run, f"chr {types['chr']}, pos {types['pos']}, saf array<double>")
