"""Tests of association between genotypes and a phenotype.

Posteriors come in long form (chr, pos, sample, p0, p1, p2), phenotypes as sample, y and covariates cov1, cov2, ...; a null phenotype
or covariate leaves the sample out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.estimators import ROUNDS, TOLERANCE, Ragged, chi2_tail, em_frequency, hwe_prior, log_likelihood

SITE = ["chr", "pos"]


def case_control(l3: DataFrame, pheno: DataFrame, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """``chr, pos, freq, freq_case, freq_control, lrt, p_value``: one frequency for all against one each for cases and controls."""
    rows = F.sort_array(F.collect_list(F.struct("y", "sample", "l0", "l1", "l2")))
    g = l3.join(pheno.where("y in (0, 1)").select("sample", F.col("y").cast("int").alias("y")), "sample").groupBy(*SITE).agg(rows.alias("r"))
    flat = F.flatten(F.transform("r", lambda x: F.array(x["l0"], x["l1"], x["l2"])))
    g = g.select(*SITE, flat.alias("l3"), F.size(F.filter("r", lambda x: x["y"] == 0)).alias("n0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b["l3"])) // 3
            flat, n0 = np.asarray(b["l3"].flatten()), np.asarray(b["n0"])
            r = Ragged(flat, sizes)
            control = np.arange(len(r.l)) - r.starts[r.site] < n0[r.site]
            parts = [r, Ragged(r.l[~control].ravel(), sizes - n0), Ragged(r.l[control].ravel(), n0)]
            p = [em_frequency(x, 0.1, rounds, tol) for x in parts]
            lik = [log_likelihood(x, hwe_prior(q)) for x, q in zip(parts, p)]
            lrt = np.maximum(2 * (lik[1] + lik[2] - lik[0]), 0)
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], *map(pa.array, (*p, lrt, chi2_tail(lrt)))], ["chr", "pos", "freq", "freq_case", "freq_control", "lrt", "p_value"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, freq double, freq_case double, freq_control double, lrt double, p_value double")


def _coded(post: DataFrame, model: str) -> DataFrame:
    """Expected genotype score ``e`` and expected square ``e2`` under the additive, dominant or recessive model."""
    p1, p2 = F.col("p1"), F.col("p2")
    e, e2 = {"add": (p1 + 2 * p2, p1 + 4 * p2), "dom": (p1 + p2, p1 + p2), "rec": (p2, p2)}[model]
    return post.withColumns({"e": e, "e2": e2})


def _gated(g: DataFrame, min_high: int, min_count: float, info: bool = False) -> DataFrame:
    """``chr, pos, n, freq, lrt`` from the sums ``copies, high0, high1, high2``; null where a gate fails."""
    n = F.col("n")
    kinds = sum((F.col(f"high{k}") >= min_high).cast("int") for k in range(3))
    ok = (kinds >= 2) & (F.least("copies", 2 * n - F.col("copies")) >= min_count)
    return g.select(*SITE, "n", (F.col("copies") / (2 * n)).alias("freq"), F.when(ok, F.col("lrt")).alias("lrt"), *(["info"] if info else []))


def score_test(post: DataFrame, pheno: DataFrame, kind: str = "normal", model: str = "add", covariates: tuple[str, ...] = (), min_high: int = 0, min_count: float = 0, dispersion: bool = True, info: bool = False) -> DataFrame:
    """``chr, pos, n, freq, lrt`` (with ``info`` also the information): score test of no effect of the unobserved genotype on a phenotype; null where a gate fails.

    ``kind`` is normal, binary or poisson.  Under the null model the phenotype depends on the covariates (and a constant) alone.  With its residuals r,
    variance function v and dispersion phi, and expected genotype e and square e2, the score is sum(e r) / phi; its information is that of
    the genotype, sum((v / phi - r^2 / phi^2) e2 + r^2 / phi^2 e^2), less what covariates explain of it.  For normal phenotypes the published test also
    takes off a term for the estimated dispersion, in which y^2 + 2 y m stands where a squared residual would be expected;
    it is kept so that values agree, and left out with ``dispersion=False``.

    Without covariates everything follows from sums in one aggregation; with covariates, many positions are solved at once.  ``min_high`` asks for so many
    confident (0.9) genotypes of at least two kinds, ``min_count`` for so many expected copies of either allele.
    """
    if covariates or kind == "poisson":
        return _score_kernel(post, pheno, kind, model, covariates, min_high, min_count, dispersion)
    x = _coded(post, model).join(pheno.where("y is not null").select("sample", F.col("y").cast("double").alias("y")), "sample")
    y, e, e2 = F.col("y"), F.col("e"), F.col("e2")
    sums = {"sy": y, "syy": y * y, "se": e, "se2": e2, "see": e * e, "sye": y * e, "sye2": y * e2, "syye2": y * y * e2, "syee": y * e * e, "syyee": y * y * e * e, "copies": F.col("p1") + 2 * F.col("p2")}
    g = x.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()), *(F.count_if(F.col(f"p{k}") > 0.9).alias(f"high{k}") for k in range(3)))
    g = g.where("n > 1 and syy - sy * sy / n > 1e-12")
    n, (sy, syy, se, se2, see, sye, sye2, syye2, syee, syyee) = F.col("n"), (F.col(k) for k in list(sums)[:-1])
    mean = sy / n
    score = sye - mean * se
    # sums of r^2 e^2 and r^2 e2 for residuals r = y - mean
    extra = syyee - 2 * mean * syee + mean * mean * see - (syye2 - 2 * mean * sye2 + mean * mean * se2)
    phi = F.lit(1.0) if kind == "binary" else (syy - n * mean * mean) / (n - 1)
    v = mean * (1 - mean) if kind == "binary" else F.lit(1.0)
    own = v * se2 / phi + extra / (phi * phi) - v * se * se / (n * phi)
    if dispersion and kind == "normal":
        own = own - (score / (phi * phi)) ** 2 / _dispersion(syy + 2 * mean * sy, n, phi)
    return _gated(g.withColumns({"lrt": (score / phi) ** 2 / F.nullif(own, F.lit(0.0)), "info": own}), min_high, min_count, info)


def _dispersion(total, n, phi):
    """Published information of the dispersion (numbers or columns): total is the sum of y^2 + 2 y m."""
    return total / (phi * phi * phi) - n / (4 * math.pi * phi * phi)


def _null_model(z: np.ndarray, y: np.ndarray, there: np.ndarray, kind: str, rounds: int = 30) -> np.ndarray:
    """Fitted means (positions x samples) of regressions on the covariates z (samples x q), over the samples that each position has."""
    w = there.astype(float)
    eta = np.zeros(w.shape)
    for _ in range(1 if kind == "normal" else rounds):
        mu = y * np.ones_like(w) if kind == "normal" else 1 / (1 + np.exp(-eta)) if kind == "binary" else np.exp(eta)
        v = np.ones_like(w) if kind == "normal" else np.maximum(mu * (1 - mu) if kind == "binary" else mu, 1e-10)
        target = y if kind == "normal" else eta + (y - mu) / v
        a = np.einsum("bn,ni,nj->bij", w * v, z, z)
        b = np.linalg.pinv(a) @ np.einsum("bn,ni->bi", w * v * target, z)[:, :, None]
        new = np.clip((z @ b)[:, :, 0] if b.ndim == 3 else z @ b, -30, 30) if kind != "normal" else (z @ b)[:, :, 0]
        done = np.abs(new - eta).max(initial=0) < 1e-10
        eta = new
        if done:
            break
    return eta if kind == "normal" else 1 / (1 + np.exp(-eta)) if kind == "binary" else np.exp(eta)


def _score_kernel(post: DataFrame, pheno: DataFrame, kind: str, model: str, covariates: tuple[str, ...], min_high: int, min_count: float, dispersion: bool) -> DataFrame:
    """The score test with covariates: a position's samples in one row, a batch of positions as one array problem.

    The phenotype table (a few numbers a sample) goes to every task.
    """
    wanted = ["y", *covariates]
    people = pheno.select("sample", *(F.col(c).cast("double").alias(c) for c in wanted)).na.drop().dropDuplicates(["sample"]).orderBy("sample").collect()
    place = {r["sample"]: i for i, r in enumerate(people)}
    y = np.array([r["y"] for r in people])
    z = np.array([[1.0, *(r[c] for c in covariates)] for r in people]).reshape(len(people), -1)
    x = _coded(post, model).join(F.broadcast(pheno.sparkSession.createDataFrame([(s, i) for s, i in place.items()], f"sample {dict(post.dtypes)['sample']}, __k int")), "sample")
    cells = F.collect_list(F.struct("__k", "e", "e2"))
    g = x.groupBy(*SITE).agg(cells.alias("r"), F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("p1") + 2 * F.col("p2")).alias("copies"), *(F.count_if(F.col(f"p{k}") > 0.9).alias(f"high{k}") for k in range(3)))
    g = g.select(*SITE, "n", "copies", "high0", "high1", "high2", F.col("r.__k").alias("k"), F.col("r.e").alias("e"), F.col("r.e2").alias("e2"))
    kept = [*SITE, "n", "copies", "high0", "high1", "high2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, max(1, 2_000_000 // max(len(y), 1))):
                part = b.slice(lo, max(1, 2_000_000 // max(len(y), 1)))
                m = part.num_rows
                row = np.repeat(np.arange(m), np.asarray(pc.list_value_length(part["k"])))
                at = np.asarray(part["k"].flatten())
                e, e2, there = np.zeros((m, len(y))), np.zeros((m, len(y))), np.zeros((m, len(y)), bool)
                e[row, at], e2[row, at], there[row, at] = np.asarray(part["e"].flatten()), np.asarray(part["e2"].flatten()), True
                mu = _null_model(z, y, there, kind)
                r = np.where(there, y - mu, 0.0)
                n = there.sum(axis=1)
                phi = (r * r).sum(axis=1) / np.maximum(n - z.shape[1], 1) if kind == "normal" else np.ones(m)
                v = there * (1.0 if kind == "normal" else mu * (1 - mu) if kind == "binary" else mu)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (e * r).sum(axis=1) / phi
                    own = ((v / phi[:, None] - r * r / phi[:, None] ** 2) * e2 + r * r / phi[:, None] ** 2 * e * e).sum(axis=1)
                    ab = np.einsum("bn,bn,ni->bi", v, e, z) / phi[:, None]
                    aa = np.einsum("bn,ni,nj->bij", v, z, z) / phi[:, None, None]
                    info = own - np.einsum("bi,bij,bj->b", ab, np.linalg.pinv(np.nan_to_num(aa)), ab)
                    if dispersion and kind == "normal":
                        info = info - (score / phi) ** 2 / _dispersion((there * (y * y + 2 * y * mu)).sum(axis=1), n, phi)
                    lrt = score**2 / info
                ok = np.isfinite(lrt) & (phi > 1e-12) & (n > z.shape[1])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(lrt, pa.float64(), mask=~ok)], [*kept, "lrt"])

    t = dict(g.dtypes)
    made = g.mapInArrow(run, ", ".join(f"{c} {t[c]}" for c in kept) + ", lrt double")
    return _gated(made, min_high, min_count)


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Least squares: coefficients and log likelihood, with the residual variance over n - p."""
    w = np.ones(len(y)) if w is None else w
    a = x.T @ (x * w[:, None])
    b = np.linalg.pinv(a) @ (x.T @ (w * y))
    res = y - x @ b
    n = w.sum()
    var = max(float((w * res * res).sum() / max(n - x.shape[1], 1)), 1e-12)
    return b, float((w * (-0.5 * np.log(2 * np.pi * var) - res * res / (2 * var))).sum())


def fit_glm(x: np.ndarray, y: np.ndarray, kind: str = "logistic", w: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic or Poisson regression by iteratively reweighted least squares: coefficients, log likelihood, covariance."""
    w = np.ones(len(y)) if w is None else w
    b = np.zeros(x.shape[1])
    cov = np.eye(x.shape[1])
    for _ in range(rounds):
        eta = np.clip(x @ b, -30, 30)
        mu = 1 / (1 + np.exp(-eta)) if kind == "logistic" else np.exp(eta)
        v = np.maximum(mu * (1 - mu) if kind == "logistic" else mu, 1e-10)
        cov = np.linalg.pinv(x.T @ (x * (w * v)[:, None]))
        step = cov @ (x.T @ (w * (y - mu)))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    eta = np.clip(x @ b, -30, 30)
    if kind == "logistic":
        lik = float((w * (y * eta - np.log1p(np.exp(eta)))).sum())
    else:
        lik = float((w * (y * eta - np.exp(eta) - np.array([math.lgamma(t + 1) for t in y]))).sum())
    return b, lik, cov


def _loglik(y: np.ndarray, eta: np.ndarray, kind: str, var: float) -> np.ndarray:
    if kind == "normal":
        return -0.5 * np.log(2 * np.pi * var) - (y - eta) ** 2 / (2 * var)
    eta = np.clip(eta, -30, 30)
    if kind == "logistic":
        return y * eta - np.log1p(np.exp(eta))
    return y * eta - np.exp(eta) - np.array([math.lgamma(t + 1) for t in y])


def _fit(x: np.ndarray, y: np.ndarray, kind: str, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    if kind == "normal":
        return fit_linear(x, y, w)
    b, lik, _ = fit_glm(x, y, kind, w)
    return b, lik


def latent_em(post: np.ndarray, y: np.ndarray, z: np.ndarray, kind: str, codes: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> tuple[float, float, int]:
    """Regression on the unobserved genotype: LRT against no effect, the effect, and the rounds used.

    Every sample enters once for each genotype, weighted by the genotype's probability given posterior and phenotype.
    """
    n = len(y)
    null, lik0 = _fit(z, y, kind)
    e = post @ codes
    b, _ = _fit(np.column_stack([e, z]), y, kind)
    big_x = np.column_stack([np.repeat(codes[None, :], n, axis=0).ravel(), np.repeat(z, 3, axis=0)])
    big_y = np.repeat(y, 3)
    var = float(((y - np.column_stack([e, z]) @ b) ** 2).sum() / max(n - z.shape[1] - 1, 1)) if kind == "normal" else 1.0
    last, lik = -np.inf, -np.inf
    for it in range(1, rounds + 1):
        logp = np.log(np.maximum(post, 1e-300)) + _loglik(big_y, big_x @ b, kind, max(var, 1e-12)).reshape(n, 3)
        top = logp.max(axis=1, keepdims=True)
        s = np.exp(logp - top)
        lik = float((np.log(s.sum(axis=1)) + top[:, 0]).sum())
        if abs(lik - last) < tol:
            break
        last = lik
        w = (s / s.sum(axis=1, keepdims=True)).ravel()
        b, _ = _fit(big_x, big_y, kind, w)
        if kind == "normal":
            var = float((w * (big_y - big_x @ b) ** 2).sum() / max(n - big_x.shape[1], 1))
    return 2 * (lik - lik0), float(b[0]), it


def _regress_sums(post: DataFrame, pheno: DataFrame, method: str, model: str) -> DataFrame:
    """``regress`` of a normal phenotype without covariates: everything follows from five sums."""
    x = _coded(post, model).join(pheno.where("y is not null").select("sample", F.col("y").cast("double").alias("y")), "sample")
    g = x.groupBy(*SITE).agg(F.count(F.lit(1)).cast("int").alias("n"), F.regr_sxx("y", "e").alias("sxx"), F.regr_syy("y", "e").alias("__yy"), F.regr_sxy("y", "e").alias("__xy"), (F.max("e") - F.min("e")).alias("__range"))
    n, beta = F.col("n"), F.col("__xy") / F.nullif(F.col("sxx"), F.lit(0.0))
    var = F.greatest((F.col("__yy") - beta * F.col("__xy")) / F.greatest(n - 2, F.lit(1)), F.lit(1e-12))
    se = F.sqrt(var / F.nullif(F.col("sxx"), F.lit(0.0)))
    ok = (n > 2) & (F.col("__yy") > 1e-12) & (F.col("__range") >= 1e-12)
    lrt = (beta / F.nullif(se, F.lit(0.0))) ** 2 if method == "wald" else n * F.log(F.col("__yy") / (n - 1) / var) + 1
    return g.select(*SITE, "n", F.when(ok, lrt).alias("lrt"), F.when(ok, beta).alias("beta"), F.when(ok, se).alias("se"), "sxx")


def regress(post: DataFrame, pheno: DataFrame, method: str = "dosage", kind: str = "normal", model: str = "add", covariates: tuple[str, ...] = (), hybrid_p: float = 0.05) -> DataFrame:
    """``chr, pos, n, lrt, beta, se, sxx``: regression of the phenotype on genotypes with covariates, one small problem for each position.

    ``sxx`` is the sum of squares of the expected genotypes about their mean: how much there is to regress on.

    ``dosage`` uses expected genotypes, ``latent`` an EM over the genotypes, ``hybrid`` the latent model only where the dosage test is
    below ``hybrid_p``, ``wald`` reports (beta / se)^2 of the dosage model.  ``kind``: normal, logistic or poisson.
    """
    if not covariates and kind == "normal" and method in ("dosage", "wald"):
        return _regress_sums(post, pheno, method, model)
    codes = {"add": np.array([0.0, 1, 2]), "dom": np.array([0.0, 1, 1]), "rec": np.array([0.0, 0, 1])}[model]
    wanted = [F.col(c).cast("double") for c in ("y", *covariates)]
    people = pheno.select("sample", F.array(*wanted).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    rows = F.sort_array(F.collect_list(F.struct("sample", "p0", "p1", "p2", "x")))
    g = post.join(people, "sample").groupBy(*SITE).agg(rows.alias("r"))
    g = g.select(*SITE, F.size("r").alias("n"), F.flatten(F.transform("r", lambda r: F.concat(F.array(r["p0"], r["p1"], r["p2"]), r["x"]))).alias("v"))
    width = 4 + len(covariates)

    def one(v: np.ndarray) -> tuple:
        v = v.reshape(-1, width)
        p, y, z = v[:, :3], v[:, 3], np.column_stack([np.ones(len(v)), v[:, 4:]])
        e = p @ codes
        return *effect(p, y, z), float(((e - e.mean()) ** 2).sum())

    def effect(p: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float | None, float | None, float | None]:
        if len(y) <= z.shape[1] + 1 or np.ptp(y) == 0 or np.ptp(p @ codes) < 1e-12:
            return None, None, None
        x = np.column_stack([p @ codes, z])
        if kind == "normal":
            b, lik1 = fit_linear(x, y)
            var = ((y - x @ b) ** 2).sum() / (len(y) - x.shape[1])
            cov = var * np.linalg.pinv(x.T @ x)
        else:
            b, lik1, cov = fit_glm(x, y, kind)
        lrt = 2 * (lik1 - _fit(z, y, kind)[1])
        se = float(np.sqrt(max(cov[0, 0], 0)))
        if method == "wald":
            return (float(b[0]) / se) ** 2 if se else None, float(b[0]), se
        if method == "latent" or (method == "hybrid" and float(chi2_tail(np.array([lrt]))[0]) < hybrid_p):
            lrt, beta, _ = latent_em(p, y, z, kind, codes)
            return float(lrt), beta, se
        return float(lrt), float(b[0]), se

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(np.asarray(v.values)) for v in b["v"]]
            cols = list(zip(*got)) if got else [()] * 4
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], b["n"], *(pa.array(c, pa.float64()) for c in cols)], ["chr", "pos", "n", "lrt", "beta", "se", "sxx"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, n int, lrt double, beta double, se double, sxx double")
