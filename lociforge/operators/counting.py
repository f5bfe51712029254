"""Counts over aligned bases: one row in ``reads`` is one base of one sample at one position.

Columns used: chr, pos, sample, base (0-3; anything else or null is N), qs, mapq, posi and isop (distance to the read's ends),
is_rev, ref, anc, ord (order of the reads at a position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import BASES, IUPAC

SITE = ["chr", "pos"]
N4 = ["n_a", "n_c", "n_g", "n_t"]


def _n(base: int, what: Column | None = None) -> Column:
    hit = F.col("base") == base
    return F.count_if(hit if what is None else hit & what)


def allele_counts(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos", "sample")) -> DataFrame:
    """Bases A, C, G, T of each group (N isn't counted)."""
    return reads.groupBy(*by).agg(*(_n(b).alias(N4[b]) for b in range(4)))


def mask_bases(reads: DataFrame, min_q: int = 13, trim5: int = 0, trim3: int = 0) -> DataFrame:
    """Bases of low quality or close to a read end become N; they still count for depth of the pile."""
    bad = (F.col("qs") < min_q) | (F.col("posi") < trim5) | (F.col("isop") < trim3)
    return reads.withColumn("base", F.when(bad, 4).otherwise(F.col("base")))


def sample_quality(reads: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Masks bases below their sample's (and, if the table has a ``base`` column, base's) quality cutoff ``min_q``."""
    on = ["sample", "base"] if "base" in cutoffs.columns else ["sample"]
    joined = reads.join(cutoffs.select(*on, "min_q"), on, "left")
    return joined.withColumn("base", F.when(F.col("qs") < F.col("min_q"), 4).otherwise(F.col("base"))).drop("min_q")


def cap_depth(reads: DataFrame, most: int, order: tuple[str, ...] = ("ord", "base", "qs")) -> DataFrame:
    """The first ``most`` bases of each sample at each position."""
    first = F.row_number().over(Window.partitionBy(*SITE, "sample").orderBy(*order))
    return reads.withColumn("__k", first).where(F.col("__k") <= most).drop("__k")


def site_depth(reads: DataFrame) -> DataFrame:
    """Total depth of each position."""
    return reads.where("base between 0 and 3").groupBy(*SITE).agg(F.count(F.lit(1)).alias("depth"))


def depth_by_sample(reads: DataFrame, samples: list[int]) -> DataFrame:
    """Depth of each position, one column a sample."""
    return reads.where("base between 0 and 3").groupBy(*SITE).agg(*(F.count_if(F.col("sample") == s).alias(f"ind{s}") for s in samples))


def counts_matrix(reads: DataFrame, samples: list[int]) -> DataFrame:
    """A, C, G, T counts of each position, four columns a sample."""
    return reads.groupBy(*SITE).agg(*(_n(b, F.col("sample") == s).alias(f"ind{s}_{BASES[b].lower()}") for s in samples for b in range(4)))


def read_lengths(reads: DataFrame) -> DataFrame:
    """Mean read length and number of reads at each position."""
    return reads.groupBy(*SITE).agg(F.avg(F.col("posi") + F.col("isop") + 1).alias("mean_length"), F.count(F.lit(1)).alias("n_reads"))


def effective_depth(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Effective base depth: the sum over bases of the smaller of base and mapping quality, within 4 to 63."""
    weight = F.greatest(F.lit(4), F.least(F.lit(63), F.col("qs"), F.col("mapq")))
    return reads.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("base") == b, weight)), F.lit(0)).alias(f"ebd_{BASES[b].lower()}") for b in range(4)))


def quality_histogram(reads: DataFrame, min_q: int = 13) -> DataFrame:
    """Bases of each quality from the lowest to the highest seen, also those without any."""
    seen = reads.where((F.col("base").between(0, 3)) & (F.col("qs") >= min_q)).groupBy("qs").agg(F.count(F.lit(1)).alias("n"))
    full = seen.agg(F.min("qs").alias("a"), F.max("qs").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("qs"))
    return full.join(seen, "qs", "left").select("qs", F.coalesce("n", F.lit(0)).alias("n"))


def depth_histogram(reads: DataFrame, most: int = 100, per_sample: bool = True) -> DataFrame:
    """Positions by depth (all above ``most`` together), per sample or over all samples."""
    by = [*SITE, "sample"] if per_sample else SITE
    depth = reads.where("base between 0 and 3").groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("depth"))
    keys = ["sample", "depth"] if per_sample else ["depth"]
    return depth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"))


def strand_counts(reads: DataFrame) -> DataFrame:
    """Counts of A, C, G, T and N of each sample and position on each strand."""
    base = F.when(F.col("base").between(0, 3), F.col("base")).otherwise(4)
    r = reads.withColumn("base", base)
    return r.groupBy(*SITE, "sample").agg(*(_n(b, F.col("is_rev") == rev).alias(f"{'rev' if rev else 'fwd'}_{'acgtn'[b]}") for rev in (False, True) for b in range(5)))


def mismatch_matrix(reads: DataFrame) -> DataFrame:
    """Bases by distance to the read's ends, quality, strand, reference base and observed base."""
    ok = F.col("base").between(0, 3) & F.col("ref").between(0, 3)
    return reads.where(ok).groupBy("posi", "isop", "qs", "is_rev", "ref", "base").agg(F.count(F.lit(1)).alias("n"))


def ancestral_errors(reads: DataFrame, mode: str = "all", seed: int = 1) -> DataFrame:
    """Counts by ancestral, reference and observed base for each sample, over the genome (chr null) and per contig.

    ``mode`` is all bases, or the first or a random (by a hash) one of each sample and position.
    """
    r = reads
    if mode in ("first", "random"):
        order = F.col("ord") if mode == "first" else F.struct(F.xxhash64(*SITE, "sample", "ord", F.lit(seed)), "ord")
        r = r.groupBy(*SITE, "sample").agg(F.min_by(F.struct("base", "ref", "anc"), order).alias("f")).select("chr", "sample", "f.*")
    r = r.select("sample", "chr", "anc", "ref", "base")
    return r.groupingSets([["sample", "anc", "ref", "base"], ["sample", "chr", "anc", "ref", "base"]], "sample", "chr", "anc", "ref", "base").agg(F.count(F.lit(1)).alias("n"))


def quality_profile(reads: DataFrame) -> DataFrame:
    """Several histograms in one pass: ``stat, value, n`` for read length, base and mapping quality, strand and mismatch by quality."""
    stats = F.array(
        F.struct(F.lit("length").alias("stat"), (F.col("posi") + F.col("isop") + 1).cast("bigint").alias("value")),
        F.struct(F.lit("qs").alias("stat"), F.col("qs").cast("bigint").alias("value")),
        F.struct(F.lit("mapq").alias("stat"), F.col("mapq").cast("bigint").alias("value")),
        F.struct(F.lit("strand").alias("stat"), F.col("is_rev").cast("bigint").alias("value")),
        F.struct(F.lit("mismatch_qs").alias("stat"), F.when(F.col("base") != F.col("ref"), F.col("qs")).cast("bigint").alias("value")),
    )
    return reads.select(F.explode(stats).alias("s")).select("s.*").where("value is not null").groupBy("stat", "value").agg(F.count(F.lit(1)).alias("n"))


def smart_counts(counts: DataFrame) -> DataFrame:
    """Counts clamped to one byte."""
    return counts.select(*[c for c in counts.columns if c not in N4], *(F.least(F.col(c), F.lit(255)).alias(c) for c in N4))


def counts_at(counts: DataFrame, sites: DataFrame, most: int = 3) -> DataFrame:
    """Counts at listed sites (chr, pos), without positions where any count exceeds ``most``."""
    return counts.join(sites.select(*SITE).distinct(), SITE, "left_semi").where(F.greatest(*N4) <= most)


def thinned_counts(reads: DataFrame, cutoffs: DataFrame, seed: int = 1) -> DataFrame:
    """Allele counts of each position for error-matched comparisons: ``cutoffs`` (base, min_q, share) keeps bases of a quality above min_q, and
    of those just one above it the given share, drawn by a hash."""
    j = reads.where("base between 0 and 3").join(cutoffs.select("base", "min_q", "share"), "base")
    draw = F.pmod(F.xxhash64(*SITE, "sample", "ord", F.lit(seed)), F.lit(1_000_000)) / 1e6
    return allele_counts(j.where((F.col("qs") > F.col("min_q") + 1) | ((F.col("qs") == F.col("min_q") + 1) & (draw < F.col("share")))), SITE)


def merge_counts(parts: list[DataFrame]) -> DataFrame:
    """Sums of sparse counts by position over several tables."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*SITE).agg(*(F.sum(c).alias(c) for c in N4))


def ranked(columns: list[str], ties_high: bool = False) -> Column:
    """Index of the largest of the columns; of several the lowest, or with ties_high the highest."""
    cells = [F.struct(F.col(c).alias("n"), F.lit(i if ties_high else -i).alias("k")) for i, c in enumerate(columns)]
    return F.abs(F.greatest(*cells)["k"])


def major_minor(table: DataFrame, columns: list[str] = N4, major: str | None = None) -> DataFrame:
    """Adds ``major`` and ``minor`` by totals per base: major is the first of the largest (or the given column), minor the last of the largest others."""
    first = F.col(major) if major else ranked(columns)
    rest = [F.struct(F.when(first == i, F.lit(-1)).otherwise(F.col(c)).cast("double").alias("n"), F.lit(i).alias("k")) for i, c in enumerate(columns)]
    return table.withColumns({"major": first.cast("int"), "minor": F.greatest(*rest)["k"].cast("int")})


def phat(counts: DataFrame, eps: float = 0.005) -> DataFrame:
    """Minor allele frequency from counts: a weighted mean of the samples' error-corrected minor shares; needs major and minor."""
    cells = F.array(*N4)
    major, minor = F.col("major") + 1, F.col("minor") + 1
    n, total = F.element_at(cells, minor), F.element_at(cells, minor) + F.element_at(cells, major)
    share = (n - eps * total) / (F.nullif(total, F.lit(0)) * (1 - 2 * eps))
    w = 2.0 * total / (total + 1.0)
    both = F.sum(F.when(total > 0, share * w)) / F.sum(F.when(total > 0, w))
    return counts.groupBy(*SITE, "major", "minor").agg(F.when(F.first("major") == F.first("minor"), 0.0).otherwise(F.greatest(F.lit(0.0), both)).alias("phat"))


def sampled_base(reads: DataFrame, seed: int = 1, by: tuple[str, ...] = ("chr", "pos", "sample")) -> DataFrame:
    """One base of each group, drawn by a hash of chr, pos, sample and seed: the same draw on every run and partitioning."""
    counts = allele_counts(reads, by)
    depth = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    mix = (F.col("pos") * 1103515245 + F.col("chr") * 12345 + (F.col("sample") if "sample" in by else F.lit(0)) * 2654435 + seed) % 2147483647
    pick = F.pmod(mix, F.nullif(depth, F.lit(0)))
    a, c, g = F.col("n_a"), F.col("n_a") + F.col("n_c"), F.col("n_a") + F.col("n_c") + F.col("n_g")
    return counts.where(depth > 0).select(*by, F.when(pick < a, 0).when(pick < c, 1).when(pick < g, 2).otherwise(3).alias("base"))


def majority_base(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos", "sample")) -> DataFrame:
    """The commonest base of each group, the lowest of several."""
    counts = allele_counts(reads, by).where("n_a + n_c + n_g + n_t > 0")
    return counts.select(*by, ranked(N4).cast("int").alias("base"))


def deepest_base(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """The base of the highest effective depth of each group, the lowest of several."""
    depth = effective_depth(reads, by)
    cols = [f"ebd_{b.lower()}" for b in BASES]
    return depth.where(F.greatest(*cols) > 0).select(*by, ranked(cols).cast("int").alias("base"))


def exploded_bases(bases: DataFrame, ref: DataFrame) -> DataFrame:
    """Bases at listed positions (chr, pos) only, N elsewhere in their contigs: a consensus that shows variable positions alone."""
    return bases.join(ref.select(*SITE).distinct(), SITE, "left_semi")


def iupac_base(reads: DataFrame, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """The ambiguity code of all bases seen in each group."""
    counts = allele_counts(reads, by)
    seen = F.concat(*(F.when(F.col(c) > 0, F.lit(BASES[i])).otherwise("") for i, c in enumerate(N4)))
    code = F.element_at(F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv)), seen)
    return counts.where("n_a + n_c + n_g + n_t > 0").select(*by, code.alias("code"))


def haplo_call(calls: DataFrame, min_minor: int = 0, max_missing: int | None = None, n_samples: int | None = None) -> DataFrame:
    """Haploid calls per position with their major allele; sites with too few other calls or too many missing are dropped."""
    totals = calls.groupBy(*SITE).agg(*(_n(b).alias(N4[b]) for b in range(4)))
    sites = major_minor(totals).withColumn("n_called", sum(F.col(c) for c in N4))
    sites = sites.where(F.col("n_called") - F.greatest(*N4) >= min_minor)
    if max_missing is not None and n_samples is not None:
        sites = sites.where(F.lit(n_samples) - F.col("n_called") <= max_missing)
    return calls.join(sites.select(*SITE, "major"), SITE)


def consensus_lines(bases: DataFrame, contigs: DataFrame, per_line: int = 50) -> DataFrame:
    """FASTA lines ``chr, line, seq`` of base codes, N where there is none; lines are assembled in parallel, not per contig."""
    letter = F.when(F.col("base").between(0, 3), F.substring(F.lit(BASES), F.col("base") + 1, F.lit(1))).otherwise("N")
    placed = bases.select("chr", F.floor(F.col("pos") / per_line).alias("line"), (F.col("pos") % per_line).cast("int").alias("off"), letter.alias("letter"))
    by_line = placed.groupBy("chr", "line").agg(F.map_from_entries(F.collect_list(F.struct("off", "letter"))).alias("m"))
    frame = contigs.select("chr", F.col("length").alias("__len"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / per_line).cast("bigint"))).alias("line"))
    width = F.least(F.lit(per_line), F.col("__len") - F.col("line") * per_line).cast("int")
    seq = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit("N"))), "")
    return frame.join(by_line, ["chr", "line"], "left").select("chr", "line", seq.alias("seq"))


# site-level filters

def keep_sites(table: DataFrame, sites: DataFrame, complement: bool = False) -> DataFrame:
    """Rows at listed positions, or with ``complement`` at all others."""
    return table.join(sites.select(*SITE).distinct(), SITE, "left_anti" if complement else "left_semi")


def in_regions(table: DataFrame, regions: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """Rows whose position lies in a region (chr, start, stop; half open), by an equi-join on position tiles."""
    spread = regions.where("stop > start").select("chr", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile))).alias("__tile"))
    near = F.floor(F.col("pos") / tile)
    cond = (F.col("t.chr") == F.col("r.chr")) & (near == F.col("r.__tile")) & (F.col("pos") >= F.col("r.start")) & (F.col("pos") < F.col("r.stop"))
    return table.alias("t").join(spread.alias("r"), cond, "left_semi")


def site_filter(counts: DataFrame, min_ind: int = 0, min_depth_ind: int = 1, max_depth_ind: int | None = None,
                min_depth: int = 0, max_depth: int | None = None, max_alleles_first: int | None = None) -> DataFrame:
    """Positions that pass the depth filters, with ``keep``, their number of informative samples, and ``depth``.

    Samples outside the per-sample depth limits count as empty; the distinct alleles are those of the first sample.
    """
    d = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    ok = d >= min_depth_ind
    if max_depth_ind is not None:
        ok &= d <= max_depth_ind
    alleles = F.when(F.col("sample") == 0, sum((F.col(c) > 0).cast("int") for c in N4))
    sites = counts.groupBy(*SITE).agg(F.count_if(ok & (d > 0)).alias("keep"), F.coalesce(F.sum(F.when(ok, d)), F.lit(0)).alias("depth"), F.coalesce(F.max(alleles), F.lit(0)).alias("__alleles"))
    sites = sites.where((F.col("keep") >= max(min_ind, 1)) & (F.col("depth") >= max(min_depth, 1)))
    if max_depth is not None:
        sites = sites.where(F.col("depth") <= max_depth)
    if max_alleles_first is not None:
        sites = sites.where(F.col("__alleles") <= max_alleles_first)
    return sites.drop("__alleles")
