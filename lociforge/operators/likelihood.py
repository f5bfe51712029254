"""Genotype likelihoods of samples at positions, and site-level results from them.

``gl`` columns are natural-log likelihoods of the ten genotypes, rescaled so that the largest is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.genotypes import GENOTYPES, PAIRS, genotype, is_transition, log_error, logsumexp

SITE = ["chr", "pos"]


def rescaled(values: list[Column]) -> Column:
    """Ten log likelihoods as an array relative to the largest."""
    top = F.greatest(*values)
    return F.array(*(v - top for v in values))


def gl_gatk(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos", "sample")) -> DataFrame:
    """Independent-error model: each base adds its log probability given the genotype; sums are taken base by base on the map side."""
    both, one, none = log_error(F.col("qs").cast("double"))
    kinds = {"hom": both, "het": one, "off": none}
    sums = reads.where("base between 0 and 3").groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("base") == b, x)), F.lit(0.0)).alias(f"{k}{b}") for k, x in kinds.items() for b in range(4)))
    values = [sum((F.col(f"{('hom' if a == c else 'het') if b in (a, c) else 'off'}{b}") for b in range(1, 4)), F.col(f"{('hom' if a == c else 'het') if 0 in (a, c) else 'off'}0")) for a, c in GENOTYPES]
    return sums.select(*by, rescaled(values).alias("gl"))


def gl_errors(counts: DataFrame, errors: list[list[float]]) -> DataFrame:
    """Multinomial model: allele counts with a 4 x 4 matrix of type-specific error rates (row true base, column observed)."""
    cells = [F.col(c) for c in ("n_a", "n_c", "n_g", "n_t")]
    values = [sum((cells[b] * F.log(F.lit((errors[a][b] + errors[c][b]) / 2)) for b in range(1, 4)), cells[0] * F.log(F.lit((errors[a][0] + errors[c][0]) / 2))) for a, c in GENOTYPES]
    return counts.where("n_a + n_c + n_g + n_t > 0").select("chr", "pos", "sample", rescaled(values).alias("gl"))


def gl_sampled(bases: DataFrame) -> DataFrame:
    """Likelihoods of one sampled base: 1 for its homozygote, 1/2 for heterozygotes that hold it, otherwise (almost) 0."""
    values = [F.when((F.col("base") == a) & (F.col("base") == c), 0.0).when((F.col("base") == a) | (F.col("base") == c), F.log(F.lit(0.5))).otherwise(F.lit(-1e30)) for a, c in GENOTYPES]
    return bases.select("chr", "pos", "sample", F.array(*values).alias("gl"))


def informative(gl: str = "gl") -> Column:
    """Whether the likelihoods tell the genotypes apart at all."""
    return F.array_max(gl) - F.array_min(gl) > 1e-9


def effective_size(gl: DataFrame) -> DataFrame:
    """Samples with information at each position."""
    return gl.where(informative()).groupBy(*SITE).agg(F.count(F.lit(1)).alias("keep"))


def pair_scores(gl: DataFrame) -> DataFrame:
    """For each pair of alleles at each position the log likelihood with Hardy-Weinberg weights 1/4, 1/2, 1/4 (``s01 ... s23``) and the
    mean expected frequency of the second allele under these weights (``e01 ... e23``)."""
    g = [F.get("gl", F.lit(i)) for i in range(10)]
    out = []
    for a, b in PAIRS:
        logs = [g[genotype(a, a)], g[genotype(a, b)] + 0.6931471805599453, g[genotype(b, b)]]
        top = F.greatest(*logs)
        w = [F.exp(x - top) for x in logs]
        out += [F.sum(logsumexp(logs) - 1.3862943611198906).alias(f"s{a}{b}"), F.avg((w[1] + 2 * w[2]) / (2 * (w[0] + w[1] + w[2]))).alias(f"e{a}{b}")]
    return gl.where(informative()).groupBy(*SITE).agg(*out, F.count(F.lit(1)).alias("keep"))


def best_pair(scores: DataFrame) -> DataFrame:
    """The likeliest pair of alleles (the first of several); ``minor`` is the one whose expected frequency is below one half, the
    lower base code if both are at one half."""
    top = F.greatest(*(F.struct(F.round(F.col(f"s{a}{b}"), 9).alias("s"), F.lit(-k).alias("k"), F.round(F.col(f"e{a}{b}"), 9).alias("e")) for k, (a, b) in enumerate(PAIRS)))
    k = -top["k"]
    first, second = F.get(F.array(*(F.lit(a) for a, _ in PAIRS)), k), F.get(F.array(*(F.lit(b) for _, b in PAIRS)), k)
    swap = top["e"] >= 0.5
    return scores.select(*SITE, "keep", F.when(swap, second).otherwise(first).alias("major"), F.when(swap, first).otherwise(second).alias("minor"))


def best_minor(scores: DataFrame, major: DataFrame) -> DataFrame:
    """The likeliest minor allele given the major (table chr, pos, major, for example the reference base); N drops the site."""
    j = scores.join(major.where("major between 0 and 3").select(*SITE, "major"), SITE)
    cells = [F.struct(F.when(F.col("major").isin(a, b), F.round(F.col(f"s{a}{b}"), 9)).alias("s"), F.lit(-k).alias("k"), F.lit(a + b).alias("sum")) for k, (a, b) in enumerate(PAIRS)]
    return j.select(*SITE, "keep", "major", (F.greatest(*cells)["sum"] - F.col("major")).alias("minor"))


def three(gl: DataFrame, alleles: DataFrame) -> DataFrame:
    """Likelihoods (linear, largest 1) of major/major, major/minor and minor/minor: ``l0, l1, l2`` of informative samples."""
    lut = F.array(*(F.lit(genotype(a, b)) for a in range(4) for b in range(4)))

    def at(a: str, b: str) -> Column:
        return F.get("gl", F.get(lut, F.col(a) * 4 + F.col(b)))

    j = gl.join(alleles.select(*SITE, "major", "minor"), SITE)
    logs = [at("major", "major"), at("major", "minor"), at("minor", "minor")]
    top = F.greatest(*logs)
    return j.where(F.greatest(*logs) - F.least(*logs) > 1e-9).select(*SITE, "major", "minor", "sample", *(F.exp(x - top).alias(f"l{i}") for i, x in enumerate(logs)))


def collected(l3: DataFrame) -> DataFrame:
    """One row for each position: its samples in order and their likelihoods as one flat array (three each)."""
    rows = F.sort_array(F.collect_list(F.struct("sample", "l0", "l1", "l2")))
    g = l3.groupBy(*SITE, "major", "minor").agg(rows.alias("r"))
    return g.select(*SITE, "major", "minor", F.size("r").alias("n"), F.col("r.sample").alias("samples"), F.flatten(F.transform("r", lambda x: F.array(x["l0"], x["l1"], x["l2"]))).alias("l3"))


def posterior(l3: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Genotype posteriors ``p0, p1, p2``: with a table chr, pos, freq, or a column ``freq``, under Hardy-Weinberg, otherwise
    under a uniform prior; the frequency stays as a column."""
    if freq is None and "freq" not in l3.columns:
        w = [F.col("l0"), F.col("l1"), F.col("l2")]
        rows = l3
    else:
        rows = l3 if freq is None else l3.join(freq.select(*SITE, "freq"), SITE)
        p = F.col("freq")
        w = [F.col("l0") * (1 - p) * (1 - p), F.col("l1") * 2 * p * (1 - p), F.col("l2") * p * p]
    total = w[0] + w[1] + w[2]
    return rows.select(*SITE, "major", "minor", "sample", *(["freq"] if "freq" in rows.columns else []), *(F.when(total > 0, x / total).otherwise(1 / 3).alias(f"p{i}") for i, x in enumerate(w)))


def panel_posterior(l3: DataFrame, panel: DataFrame, freq: DataFrame) -> DataFrame:
    """Posteriors under a frequency that adds the sample's to a panel's allele counts (chr, pos, ac, an)."""
    n = l3.groupBy(*SITE).agg(F.count(F.lit(1)).alias("keep"))
    mixed = panel.join(freq.select(*SITE, "freq"), SITE).join(n, SITE)
    return posterior(l3, mixed.select(*SITE, ((F.col("ac") + F.col("freq") * F.col("keep")) / (F.col("an") + F.col("keep"))).alias("freq")))


def posterior_frequency(post: DataFrame) -> DataFrame:
    """Allele frequency as the mean of the posteriors' expected minor alleles."""
    return post.groupBy(*SITE).agg((F.avg(F.col("p1") + 2 * F.col("p2")) / 2).alias("freq"), F.count(F.lit(1)).alias("n"))


def call_genotypes(post: DataFrame, cutoff: float = 1 / 3) -> DataFrame:
    """Number of minor alleles of the likeliest genotype (the lowest of several), -1 if its posterior isn't above the cutoff."""
    top = F.greatest("p0", "p1", "p2")
    call = F.when(top <= cutoff, -1).when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).otherwise(2)
    return post.select(*SITE, "sample", call.cast("int").alias("geno"), top.alias("prob"))


def gate_genotypes(calls: DataFrame, counts: DataFrame, alleles: DataFrame, min_depth: int = 0, max_depth: int | None = None, min_share: float = 0.0, min_ind: int = 0) -> DataFrame:
    """Calls with -1 where the sample's depth at the position is out of bounds, or where a heterozygote's rarer allele has less than
    ``min_share`` of the reads; positions with fewer than ``min_ind`` calls left are dropped.

    ``counts`` are allele counts by sample, ``alleles`` the positions' major and minor alleles.
    """
    cells = F.array("n_a", "n_c", "n_g", "n_t")
    depth = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    j = calls.join(counts.select(*SITE, "sample", cells.alias("__n"), depth.alias("__d")), [*SITE, "sample"]).join(alleles.select(*SITE, F.col("major").alias("__a"), F.col("minor").alias("__b")), SITE)
    bad = F.col("__d") < min_depth
    if max_depth is not None:
        bad |= F.col("__d") > max_depth
    bad |= (F.col("geno") == 1) & (F.least(F.get("__n", F.col("__a")), F.get("__n", F.col("__b"))) < min_share * F.col("__d"))
    j = j.withColumn("geno", F.when(bad, -1).otherwise(F.col("geno"))).drop("__n", "__d", "__a", "__b")
    enough = j.where("geno >= 0").groupBy(*SITE).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= min_ind) if min_ind > 0 else None
    return j if enough is None else j.join(enough.drop("__k"), SITE, "left_semi")


def drop_transitions(sites: DataFrame) -> DataFrame:
    """Positions whose alleles differ by a transversion."""
    return sites.where(~is_transition(F.col("major"), F.col("minor")))


def psmc_likelihoods(gl: DataFrame, transversions: bool = False) -> DataFrame:
    """Log likelihood of a homozygous and of a heterozygous site, summed over the genotypes of each kind."""
    g = [F.get("gl", F.lit(i)) for i in range(10)]
    hets = [(a, b) for a, b in PAIRS if not (transversions and abs(a - b) == 2)]
    hom = logsumexp([g[genotype(a, a)] for a in range(4)]) - F.log(F.lit(4.0))
    return gl.select(*SITE, "sample", hom.alias("hom"), (logsumexp([g[genotype(a, b)] for a, b in hets]) - F.log(F.lit(float(len(hets))))).alias("het"))
