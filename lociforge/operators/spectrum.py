"""Site-frequency spectra, and what follows from them: diversity, neutrality, fixation indices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import harmonic, neutrality
from lociforge.operators.iterative import held, total_of


def joined_safs(safs: list[DataFrame]) -> DataFrame:
    """Positions that all populations have, with columns saf0, saf1, ..."""
    named = [s.select("chr", "pos", F.col("saf").alias(f"saf{i}")) for i, s in enumerate(safs)]
    return reduce(lambda a, b: a.join(b, ["chr", "pos"]), named)


def fold_map(dims: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each bin of a spectrum the bin it folds into, and the weight 2 of bins that are their own mirror image."""
    at = np.arange(int(np.prod(dims))).reshape(dims)
    mirror = at[tuple(slice(None, None, -1) for _ in dims)].ravel()
    total = np.indices(dims).sum(axis=0).ravel()
    whole = sum(d - 1 for d in dims)
    # of two mirror images in the middle the one with the lower number counts
    to = np.where(2 * total > whole, mirror, np.where(2 * total == whole, np.minimum(at.ravel(), mirror), at.ravel()))
    return to, np.where(mirror == at.ravel(), 2.0, 1.0)


def _joint(b: pa.RecordBatch, k: int) -> np.ndarray:
    """Linear likelihoods (sites x flattened bins, last population fastest)."""
    return _product([np.exp(np.asarray(b[f"saf{i}"].flatten(), dtype=np.float64).reshape(b.num_rows, -1)) for i in range(k)])


def _product(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda a, x: (a[:, :, None] * x[:, None, :]).reshape(len(x), -1), parts)


def packed(joint: DataFrame, k: int, weights: bool = False) -> DataFrame:
    """Blocks of positions as one row each: ``n, s0 ..., w``, the linear likelihoods of every population and the weights as raw doubles.

    Iterations over the table then decode a few large buffers instead of one list for each position.
    """
    cols = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = [np.exp(np.asarray(b[f"saf{i}"].flatten(), dtype=np.float64)).tobytes() for i in range(k)]
                w = np.asarray(b["weight"], dtype=np.float64) if weights else np.ones(b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (*data, w.tobytes()))], ["n", *cols, "w"])

    return joint.mapInArrow(run, "n int, " + ", ".join(f"{c} binary" for c in (*cols, "w")))


def _folded(g: np.ndarray, fold: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros_like(g)
    np.add.at(out.T, fold[0], (g * fold[1]).T)
    return out


def em_step(blocks: DataFrame, sfs: np.ndarray, k: int, fold: tuple[np.ndarray, np.ndarray] | None, tasks: int | None = None, curvature: bool = False) -> tuple[np.ndarray, float, float, np.ndarray | None]:
    """New spectrum, log likelihood and number of sites from ``packed`` blocks, and with ``curvature`` the negative second derivatives of the mean
    log likelihood: each task sends one row of sums, whatever the number of its sites."""
    size = len(sfs)

    def fill(b: pa.RecordBatch, t: np.ndarray) -> None:
        for row in range(b.num_rows):
            n = b["n"][row].as_py()
            g = _product([np.frombuffer(b[f"s{i}"][row].as_buffer()).reshape(n, -1) for i in range(k)])
            if fold is not None:
                g = _folded(g, fold)
            w = np.frombuffer(b["w"][row].as_buffer())
            s = g @ sfs
            ok = (s > 0) & (w > 0)
            g, s, w = g[ok], s[ok], w[ok]
            t[:size] += (w / s) @ g
            t[size] += float((w * np.log(s)).sum())
            t[size + 1] += float(w.sum())
            if curvature:
                t[size + 2 :] += ((g * (w / s**2)[:, None]).T @ g).ravel()

    t = total_of(blocks, size + 2 + size * size * curvature, fill, tasks)
    n = max(float(t[size + 1]), 1e-300)
    return (sfs * t[:size] / n if t[size + 1] else sfs), float(t[size]), float(t[size + 1]), (t[size + 2 :].reshape(size, size) / n if curvature else None)


def _nonnegative_minimum(h: np.ndarray, b: np.ndarray, x: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The y >= 0 that minimises y h y / 2 + b y, by active sets starting from x."""
    y, free = x.copy(), x > 0
    for _ in range(20 * len(y)):
        z = np.zeros_like(y)
        f = np.flatnonzero(free)
        if len(f):
            z[f] = np.linalg.solve(h[np.ix_(f, f)], -b[f])
        bad = (z < 0) & free
        if not bad.any():
            y = z
            slope = np.where(free, np.inf, h @ y + b)
            k = int(np.argmin(slope))
            if slope[k] >= -tol:
                break
            free[k] = True
        else:
            reach = np.where(bad, y / np.where(bad, y - z, 1), np.inf)
            k = int(np.argmin(reach))
            y = np.maximum(y + min(reach[k], 1.0) * (z - y), 0)
            y[k], free[k] = 0, False
    return y


#: Spectra up to so many bins are estimated by Newton steps, whose second derivatives each task sends along.
NEWTON = 400


def _newton(step: Callable, sfs: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """Sequential quadratic programming for mixture proportions: minimises -mean log likelihood + sum over nonnegative proportions, whose
    minimum sums to 1.  A few EM steps come first; a pass gives value, slope and curvature at once, so a step that fails costs one pass."""
    it, n = 0, 0.0
    for _ in range(min(4, rounds)):
        sfs, _, n, _ = step(sfs, False)
        it += 1

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        new, lik, n, h = step(np.maximum(x, 1e-300), True)
        return -lik / max(n, 1e-300) + x.sum(), 1 - new / np.maximum(x, 1e-300), h

    if not n:
        return sfs
    value, slope, h = at(sfs)
    it += 1
    while it < rounds and (-slope).max() > tol:
        h = h + np.eye(len(h)) * (1e-10 * np.trace(h) / len(h) + 1e-14)
        d = _nonnegative_minimum(h, slope - h @ sfs, sfs) - sfs
        size = 1.0
        while True:
            v, s, c = at(sfs + size * d)
            it += 1
            if v <= value + 0.01 * size * float(slope @ d) + 1e-15 or size < 1e-6 or it >= rounds:
                break
            size /= 2
        sfs, value, slope, h = sfs + size * d, v, s, c
    return sfs / sfs.sum()


def _anderson(step: Callable, sfs: np.ndarray, rounds: int, tol: float, depth: int = 6) -> np.ndarray:
    """EM with Anderson's mixing of the last steps; where that lowers the likelihood it starts anew from the plain step."""
    xs, rs, back, last = [], [], None, -np.inf
    for it in range(rounds):
        y, lik, _, _ = step(sfs, False)
        if back is not None and lik < last:
            sfs, xs, rs, back = back, [], [], None
            continue
        if it and abs(lik - last) <= tol * abs(lik):
            return y
        last = lik
        xs, rs = [*xs, sfs][-depth:], [*rs, y - sfs][-depth:]
        back = sfs = y
        if len(rs) > 1:
            dr, dx = np.diff(np.array(rs), axis=0).T, np.diff(np.array(xs), axis=0).T
            sfs = y - (dx + dr) @ np.linalg.lstsq(dr, rs[-1], rcond=1e-10)[0]
            sfs = np.where(sfs <= 0, 0.1 * y, sfs)
            sfs = sfs / sfs.sum()
    return sfs


def _squarem(step: Callable, sfs: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """EM extrapolated along its last two steps, with plain EM where that lowers the likelihood."""
    last, it = -np.inf, 0
    while it < rounds:
        x1, lik, _, _ = step(sfs, False)
        if abs(lik - last) <= tol * abs(lik):
            break
        last = lik
        x2, lik1, _, _ = step(x1, False)
        r, v = x1 - sfs, (x2 - x1) - (x1 - sfs)
        it += 2
        if float(v @ v) < 1e-30:
            sfs = x2
            continue
        a = -np.sqrt(float(r @ r) / float(v @ v))
        leap = np.maximum(sfs - 2 * a * r + a * a * v, 0)
        leap = leap / leap.sum() if leap.sum() > 0 else x2
        x3, lik3, _, _ = step(leap, False)
        it += 1
        sfs = x3 if lik3 >= lik1 else x2
    return sfs


def _plain(step: Callable, sfs: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    last = -np.inf
    for _ in range(rounds):
        sfs, lik, _, _ = step(sfs, False)
        if abs(lik - last) <= tol * abs(lik):
            break
        last = lik
    return sfs


def estimate_spectrum(safs: list[DataFrame], dims: tuple[int, ...], rounds: int = 200, tol: float = 1e-10, folded: bool = False,
                      method: str | None = None, start: np.ndarray | None = None, weights: DataFrame | None = None) -> np.ndarray:
    """Maximum-likelihood spectrum (expected counts, flattened, last population fastest) of one or more populations.

    The likelihood table is cached over the rounds; only the spectrum crosses the driver, and ``rounds`` limits the passes over the
    table.  ``method``: ``newton`` (the default up to NEWTON bins, about a dozen passes), ``anderson`` (the default beyond), ``squarem`` or
    ``em``; all climb to the same maximum.  ``weights`` (chr, pos, weight) count positions several times, as in a bootstrap.
    """
    joint = joined_safs(safs)
    if weights is not None:
        joint = joint.join(weights.select("chr", "pos", "weight"), ["chr", "pos"])
    joint, tasks = held(packed(joint, len(safs), weights is not None))
    fold = fold_map(dims) if folded else None
    size = int(np.prod(dims))
    sfs = np.full(size, 1.0 / size) if start is None else np.asarray(start, float) / np.sum(start)
    if fold is not None:
        kept = np.zeros(size)
        np.add.at(kept, fold[0], sfs)
        sfs = kept / kept.sum()
    count = 0.0

    def step(x: np.ndarray, curvature: bool) -> tuple:
        nonlocal count
        got = em_step(joint, x, len(safs), fold, tasks, curvature)
        count = got[2]
        return got

    run = {"newton": _newton, "anderson": _anderson, "squarem": _squarem, "em": _plain}[method or ("newton" if size <= NEWTON else "anderson")]
    try:
        return run(step, sfs, rounds, tol) * count
    finally:
        joint.unpersist()


def bootstrap_weights(saf: DataFrame, seed: int, by_chr: bool = False) -> DataFrame:
    """Poisson(1) weights of positions, or of whole contigs, from a hash: the same resample on every run."""
    u = F.pmod(F.xxhash64("chr", *([] if by_chr else ["pos"]), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    return saf.select("chr", "pos", weight.alias("weight")).where("weight > 0")


def spectrum_bins(dims: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Allele counts of each flattened bin, last population fastest."""
    return [tuple(int(i) for i in x) for x in np.ndindex(*dims)]


def _literal(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def site_posterior(saf: DataFrame, sfs: np.ndarray) -> DataFrame:
    """``chr, pos, post``: probability of each number of derived alleles under the spectrum as a prior."""
    prior = _literal(np.asarray(sfs, float) / np.sum(sfs))
    w = F.zip_with("saf", prior, lambda s, p: F.exp(s) * p)
    return saf.select("chr", "pos", w.alias("w")).select("chr", "pos", F.transform("w", lambda x: x / F.reduce("w", F.lit(0.0), lambda a, y: a + y)).alias("post"))


def likeliest_count(saf: DataFrame, sfs: np.ndarray) -> DataFrame:
    """The most probable number of derived alleles of each position (the lowest of several)."""
    post = site_posterior(saf, sfs)
    return post.select("chr", "pos", (F.array_position("post", F.array_max("post")) - 1).cast("int").alias("bin"))


def site_thetas(post: DataFrame, n: int, folded: bool = False) -> DataFrame:
    """Per-position estimates (linear scale) ``tw, tp, tf, th, tl`` from the posterior of n chromosomes; folded has tw and tp only."""
    i = np.arange(n + 1)
    pairs = n * (n - 1) / 2

    def weigh(w: np.ndarray) -> Column:
        return F.reduce(F.zip_with("post", _literal(w), lambda p, x: p * x), F.lit(0.0), lambda a, y: a + y)

    seg = np.where((i > 0) & ((i < n) | folded), 1 / harmonic(n), 0)
    out = {"tw": weigh(seg), "tp": weigh(i * (n - i) / pairs)}
    if not folded:
        inner = (i > 0) & (i < n)
        out |= {"tf": weigh((i == 1).astype(float)), "th": weigh(inner * i * i / pairs), "tl": weigh(inner * i / (n - 1))}
    return post.select("chr", "pos", *(v.alias(k) for k, v in out.items()))


def _placed(table: DataFrame, key: str, pos: str, step: int, kind: int) -> DataFrame:
    """The table with the origin ``__o`` of its key's windows and the key's last position ``__z``."""
    ends = table.groupBy(key).agg(F.min(pos).alias("__a"), F.max(pos).alias("__z"))
    origin = {0: F.floor(F.col("__a") / step) * step + step, 1: F.col("__a"), 2: F.lit(1)}[kind]
    return table.join(ends.select(key, origin.cast("bigint").alias("__o"), "__z"), key)


def sliding(table: DataFrame, key: str, pos: str, win: int, step: int, kind: int = 0) -> DataFrame:
    """Each row once for each window it lies in, with ``win_start`` and ``win_stop`` (half open).

    Windows of a key start at the first multiple of step above its first position (kind 0), at that position (1) or at 1 (2), and
    end with the last whole one.
    """
    t = _placed(table, key, pos, step, kind)
    low = F.greatest(F.ceil((F.col(pos) - win + 1 - F.col("__o")) / step), F.lit(0))
    high = F.least(F.floor((F.col(pos) - F.col("__o")) / step), F.floor((F.col("__z") - win - F.col("__o")) / step))
    t = t.withColumn("__k", F.explode(F.when((high >= low) & (F.col(pos) >= F.col("__o")), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return t.withColumns({"win_start": F.col("__o") + F.col("__k") * step, "win_stop": F.col("__o") + F.col("__k") * step + win}).drop("__o", "__z", "__k")


def window_sums(table: DataFrame, key: str, pos: str, win: int, step: int, sums: dict[str, Column], kind: int = 0) -> DataFrame:
    """``key, win_start, win_stop`` and sums of columns over sliding windows (as in ``sliding``).

    Where step divides win, rows are added up by steps first, and a window is the sum of win / step of these: what is copied
    is one row for each key and step, not one for each position.
    """
    add = [F.sum(v).alias(k) for k, v in sums.items()]
    if win % step:
        return sliding(table, key, pos, win, step, kind).groupBy(key, "win_start", "win_stop").agg(*add)
    t = _placed(table, key, pos, step, kind).where(F.col(pos) >= F.col("__o"))
    bins = t.groupBy(key, "__o", "__z", F.floor((F.col(pos) - F.col("__o")) / step).alias("__b")).agg(*add)
    last = F.least(F.col("__b"), F.floor((F.col("__z") - win - F.col("__o")) / step))
    first = F.greatest(F.col("__b") - (win // step - 1), F.lit(0))
    wins = bins.withColumn("__k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    g = wins.groupBy(key, "__o", "__k").agg(*(F.sum(k).alias(k) for k in sums))
    return g.select(key, (F.col("__o") + F.col("__k") * step).alias("win_start"), (F.col("__o") + F.col("__k") * step + win).alias("win_stop"), *sums)


def window_thetas(sites: DataFrame, n: int, win: int, step: int, key: str = "chr", pos: str = "pos", kind: int = 0) -> DataFrame:
    """Sums of the per-position estimates (linear scale) over sliding windows, with the neutrality statistics."""
    g = window_sums(sites, key, pos, win, step, {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("tw", "tp", "tf", "th", "tl")} | {"n_sites": F.lit(1)}, kind)
    return g.withColumns(neutrality(n, F.col("tw"), F.col("tp"), F.col("tf"), F.col("th"), F.col("tl")))


def total_thetas(sites: DataFrame, n: int, key: str = "chr", pos: str = "pos", drop_last: bool = True) -> DataFrame:
    """One window for each key; like the established tool it leaves out the last position unless told otherwise.

    Sums by position are added up with the last position's own kept aside, so partial sums meet and no key is gathered.
    """
    cols = ("tw", "tp", "tf", "th", "tl")
    s = sites
    if drop_last:
        last = sites.groupBy(key).agg(F.max(pos).alias("__z"))
        s = sites.join(last, key).where(F.col(pos) < F.col("__z"))
    g = s.groupBy(key).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols), F.count(F.lit(1)).alias("n_sites"))
    return g.withColumns(neutrality(n, F.col("tw"), F.col("tp"), F.col("tf"), F.col("th"), F.col("tl")))


def fst_coefficients(n1: int, n2: int, kind: str = "reynolds") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the fixation index for each pair of allele counts, flattened."""
    p1, p2 = np.arange(n1 + 1)[:, None] / n1, np.arange(n2 + 1)[None, :] / n2
    if kind == "hudson":
        a = (p1 - p2) ** 2 - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)
        b = p1 * (1 - p2) + p2 * (1 - p1)
    else:
        apart = (p1 - p2) ** 2
        within = (n1 * 2 * p1 * (1 - p1) + n2 * 2 * p2 * (1 - p2)) / (4 * n1 * n2 * (n1 + n2 - 1))
        a, b = apart - (n1 + n2) * within, apart + (4 * n1 * n2 - n1 - n2) * within
    return a.ravel(), b.ravel()


def fst_sites(saf1: DataFrame, saf2: DataFrame, sfs: np.ndarray, n1: int, n2: int, kind: str = "reynolds", folded: bool = False) -> DataFrame:
    """``chr, pos, a, b``: expected numerator and denominator of each position under the joint spectrum."""
    prior = np.asarray(sfs, float) / np.sum(sfs)
    a, b = fst_coefficients(n1, n2, kind)
    fold = fold_map((n1 + 1, n2 + 1)) if folded else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            g = _joint(x, 2)
            if fold is not None:
                g = _folded(g, fold)
            post = g * prior
            post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([x["chr"], x["pos"], pa.array(post @ a), pa.array(post @ b)], ["chr", "pos", "a", "b"])

    joint = joined_safs([saf1, saf2])
    types = dict(joint.dtypes)
    return joint.mapInArrow(run, f"chr {types['chr']}, pos {types['pos']}, a double, b double")


def fst_summary(ab: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted (mean of ratios) and weighted (ratio of sums) index, of everything or of each group."""
    ok = ab.where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    ratio = F.col("a") / F.nullif(F.col("b"), F.lit(0.0))
    return ok.groupBy(*by).agg(F.avg(ratio).alias("fst_unweighted"), (F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0))).alias("fst_weighted"), F.count(F.lit(1)).alias("n_sites"))


def fst_windows(ab: DataFrame, win: int, step: int, kind: int = 0) -> DataFrame:
    """Both indices over sliding windows of each contig."""
    a, b = F.col("a"), F.col("b")
    ok = ab.where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    g = window_sums(ok, "chr", "pos", win, step, {"a": a, "b": b, "r": F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)), "k": F.when(b != 0, 1).otherwise(0), "n_sites": F.lit(1)}, kind)
    return g.select("chr", "win_start", "win_stop", (F.col("r") / F.nullif(F.col("k"), F.lit(0))).alias("fst_unweighted"), (a / F.nullif(b, F.lit(0.0))).alias("fst_weighted"), "n_sites")


def fst_from_spectrum(sfs: np.ndarray, n1: int, n2: int, kind: str = "reynolds") -> tuple[float, float]:
    """Unweighted and weighted index of a joint spectrum of two populations (n1 and n2 chromosomes); the fixed corners are left out."""
    x = np.array(sfs, float).reshape(n1 + 1, n2 + 1)
    x[0, 0] = x[n1, n2] = 0
    a, b = fst_coefficients(n1, n2, kind)
    w = x.ravel() / x.sum()
    ok = b != 0
    return float((w[ok] * a[ok] / b[ok]).sum()), float((w * a).sum() / (w * b).sum())


def branch_statistics(f01: float, f02: float, f12: float) -> tuple[float, float, float]:
    """Population branch statistics of three populations from their pairwise indices."""
    t01, t02, t12 = (-np.log(1 - f) for f in (f01, f02, f12))
    return (t01 + t02 - t12) / 2, (t01 + t12 - t02) / 2, (t02 + t12 - t01) / 2


def block_spectra(saf: DataFrame, size: int, dim: int, rounds: int = 50) -> DataFrame:
    """``chr, block, n_sites, sfs``: the spectrum of each run of ``size`` consecutive positions of a contig.

    Positions are numbered per (contig, tile) and tiles by a running sum of their sizes, so no task numbers a whole contig.
    """
    tile = F.floor(F.col("pos") / 1_000_000)
    t = saf.withColumn("__t", tile)
    per = t.groupBy("chr", "__t").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chr").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("__k", F.row_number().over(Window.partitionBy("chr", "__t").orderBy("pos")) - 1)
    t = t.join(per.select("chr", "__t", before.alias("__b")), ["chr", "__t"]).withColumn("block", F.floor((F.col("__b") + F.col("__k")) / size))
    g = t.groupBy("chr", "block").agg(F.flatten(F.collect_list("saf")).alias("s"), F.count(F.lit(1)).alias("n_sites"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b["s"]:
                like = np.exp(np.asarray(s.values, dtype=np.float64).reshape(-1, dim))
                x = np.full(dim, 1 / dim)
                for _ in range(rounds):
                    post = like * x
                    new = (post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
                    if np.abs(new - x).max() < 1e-8:
                        break
                    x = new
                out.append(x * len(like))
            yield pa.RecordBatch.from_arrays([b["chr"], b["block"], b["n_sites"], pa.array(out, pa.list_(pa.float64()))], ["chr", "block", "n_sites", "sfs"])

    return g.select("chr", "block", "n_sites", "s").mapInArrow(run, f"chr {dict(saf.dtypes)['chr']}, block bigint, n_sites bigint, sfs array<double>")


def check_positions(saf: DataFrame) -> DataFrame:
    """Positions that occur more than once (none in a sound table)."""
    return saf.groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def concatenated(safs: list[DataFrame]) -> DataFrame:
    """Tables of different regions of one population as one; a position in two of them is an error that ``check_positions`` shows."""
    return reduce(DataFrame.unionByName, safs)


def variable_sites(safs: list[DataFrame], spectra: list[np.ndarray]) -> DataFrame:
    """Likeliest allele count of each population at positions where not all are fixed for the same allele: ``chr, pos, bin0, bin1, ...``."""
    bins = [likeliest_count(s, x).withColumnRenamed("bin", f"bin{i}") for i, (s, x) in enumerate(zip(safs, spectra))]
    t = reduce(lambda a, b: a.join(b, ["chr", "pos"]), bins)
    none = reduce(lambda a, b: a & b, [F.col(f"bin{i}") == 0 for i in range(len(bins))])
    full = reduce(lambda a, b: a & b, [F.col(f"bin{i}") == len(x) - 1 for i, x in enumerate(spectra)])
    return t.where(~none & ~full)
