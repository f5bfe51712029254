"""Text tables of every result, and readers of those that later steps start from.

Writers give columns as text, in the layout that established tools read, positions counted from 1; ``write_tsv`` of ``sinks`` puts them into files in
order.  ``SINKS`` names them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.genotypes import BASES, base_code, base_letter
from lociforge.sources.sinks import mafs, write_tsv


def _six(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.format_string("%.6f", x))


def _place(chrom: str = "Chromo", pos: str = "Position") -> list[Column]:
    return [F.col("chr").alias(chrom), (F.col("pos") + 1).alias(pos)]


def _alleles(major: str = "Major", minor: str = "Minor") -> list[Column]:
    return [base_letter(F.col("major")).alias(major), base_letter(F.col("minor")).alias(minor)]


def _wide(rows: DataFrame, keys: list[str], samples: list, value: Column, none: Column) -> tuple[DataFrame, list[Column]]:
    """One row for each key with a cell for each sample: the grouped table and the cells."""
    m = F.map_from_entries(F.collect_list(F.struct("sample", value.alias("v"))))
    kind = dict(rows.dtypes)["sample"]
    return rows.groupBy(*keys).agg(m.alias("m")), [F.coalesce(F.try_element_at("m", F.lit(s).cast(kind)), none) for s in samples]


def genotypes(calls: DataFrame, samples: list, alleles: bool = True, number: bool = True, letters: bool = False, called: bool = False, all_three: bool = False) -> DataFrame:
    """``chr, pos, [major, minor]`` and for each sample, as chosen, the number of minor alleles (-1 if not called), the two letters (NN), the
    posterior of the call, and all three posteriors.  ``calls``: chr, pos, major, minor, sample, geno and, where needed, prob, p0, p1, p2."""
    a, b = base_letter(F.col("major")), base_letter(F.col("minor"))
    parts, blank = [], []
    if number:
        parts.append(F.col("geno").cast("string"))
        blank.append(F.lit("-1"))
    if letters:
        parts.append(F.when(F.col("geno") == 0, F.concat(a, a)).when(F.col("geno") == 1, F.concat(a, b)).when(F.col("geno") == 2, F.concat(b, b)).otherwise("NN"))
        blank.append(F.lit("NN"))
    if called:
        parts.append(_six("prob"))
        blank.append(_six(F.lit(1 / 3)))
    if all_three:
        parts += [_six(f"p{k}") for k in range(3)]
        blank += [_six(F.lit(1 / 3))] * 3
    g, cells = _wide(calls, ["chr", "pos", "major", "minor"], samples, F.array(*parts), F.array(*blank))
    width = len(parts)
    flat = [F.get(c, F.lit(k)).alias(f"s{i}_{k}") for i, c in enumerate(cells) for k in range(width)]
    return g.select(*_place("chr", "pos"), *(_alleles("major", "minor") if alleles else []), *flat)


def associations(lrt: DataFrame) -> DataFrame:
    """``Chromosome, Position, [Major, Minor,] Frequency, N, LRT, P`` and whatever of ``beta, SE, high_WT, high_HE, high_HO, emIter`` is there; a test that a
    gate stopped has -999."""
    names = {"beta": "beta", "se": "SE", "high0": "high_WT", "high1": "high_HE", "high2": "high_HO", "rounds": "emIter"}
    more = [F.col(c).alias(n) for c, n in names.items() if c in lrt.columns]
    p = [_six("p_value").alias("P")] if "p_value" in lrt.columns else []
    frequency = [_six("freq").alias("Frequency")] if "freq" in lrt.columns else []
    return lrt.select(*_place("Chromosome"), *(_alleles() if "major" in lrt.columns else []), *frequency, F.col("n").alias("N"), F.coalesce(_six("lrt"), F.lit("-999.000000")).alias("LRT"), *p, *more)


def write_associations(tests: dict[str, DataFrame], path: str) -> None:
    """One folder of text for each phenotype."""
    for name, t in tests.items():
        write_tsv(associations(t), f"{path}/pheno={name}", "Chromosome", "Position")


def hardy_weinberg(hwe: DataFrame) -> DataFrame:
    """``Chromo, Position, Major, Minor, hweFreq, Freq, F, LRT, p-value, hetFreq``."""
    return hwe.select(*_place(), *_alleles(), *(_six(c).alias(n) for c, n in (("hwe_freq", "hweFreq"), ("freq", "Freq"), ("f", "F"), ("lrt", "LRT"))), F.format_string("%e", "p_value").alias("p-value"), _six("het_freq").alias("hetFreq"))


def statistics(stats: DataFrame) -> DataFrame:
    """``Chromo, Position``, the strand counts joined by blanks, the three strand statistics and the deviates joined by colons."""
    some = lambda *cs: F.concat_ws(":", *(F.coalesce(_six(c), F.lit("nan")) for c in cs if c in stats.columns))
    counts = F.concat_ws(" ", "n_major_fwd", "n_minor_fwd", "n_major_rev", "n_minor_rev")
    return stats.select(*_place(), counts.alias("+Major +Minor -Major -Minor"), some("sb1", "sb2", "sb3_p").alias("SB1:SB2:SB3"), some("z_qs", "z_mapq", "z_edge").alias("baseQ:mapQ:edge"), some("het_bias_p").alias("hetStat"))


def haploid(calls: DataFrame, samples: list) -> DataFrame:
    """``chr, pos, major, ind0, ind1, ...`` of haploid calls (chr, pos, major, sample, base)."""
    g, cells = _wide(calls, ["chr", "pos", "major"], samples, base_letter(F.col("base")), F.lit("N"))
    return g.select(*_place("chr", "pos"), base_letter(F.col("major")).alias("major"), *(c.alias(f"ind{i}") for i, c in enumerate(cells)))


def haploid_tped(calls: DataFrame, samples: list) -> DataFrame:
    """Transposed PLINK columns of haploid calls: each base twice, 0 0 where there is none."""
    g, cells = _wide(calls, ["chr", "pos"], samples, F.when(F.col("base").between(0, 3), F.concat_ws(" ", base_letter(F.col("base")), base_letter(F.col("base")))).otherwise("0 0"), F.lit("0 0"))
    return g.select("chr", F.concat_ws("_", "chr", F.col("pos") + 1).alias("id"), F.lit("0").alias("cm"), (F.col("pos") + 1).alias("pos"), *(c.alias(f"ind{i}") for i, c in enumerate(cells)))


def abba_baba(blocks: DataFrame, block: int) -> DataFrame:
    """``CHR, BLOCKstart, BLOCKend`` and the numbers of ABBA and BABA sites of every combination (columns of three samples)."""
    combos = [tuple(r) for r in blocks.select("h1", "h2", "h3").distinct().orderBy("h3", "h1", "h2").collect()]  # samples, not data
    own = lambda c, k: F.coalesce(F.max(F.when((F.col("h1") == c[0]) & (F.col("h2") == c[1]) & (F.col("h3") == c[2]), F.col(k))), F.lit(0))
    cells = [own(c, k).alias(f"{k[2:].upper()}_{c[0]}_{c[1]}_{c[2]}") for c in combos for k in ("n_abba", "n_baba")]
    return blocks.groupBy("chr", "block").agg(*cells, F.first("chr").alias("__c")).select(F.col("chr").alias("CHR"), (F.col("block") * block).alias("BLOCKstart"), ((F.col("block") + 1) * block).alias("BLOCKend"), *(f"{k}_{c[0]}_{c[1]}_{c[2]}" for c in combos for k in ("ABBA", "BABA")))


def population_patterns(patterns: DataFrame, block: int) -> DataFrame:
    """``CHR, BLOCKstart, BLOCKend, H1 ... H4, Numer, Denom, numSites`` and the 256 patterns, named by their four base codes."""
    names = ["".join(str(k // 4**i % 4) for i in (3, 2, 1, 0)) for k in range(256)]
    return patterns.select(F.col("chr").alias("CHR"), (F.col("block") * block).alias("BLOCKstart"), ((F.col("block") + 1) * block).alias("BLOCKend"), *(F.col(f"h{i}").alias(f"H{i}") for i in (1, 2, 3, 4)),
                           _six(F.col("n_abba") - F.col("n_baba")).alias("Numer"), _six(F.col("n_abba") + F.col("n_baba")).alias("Denom"), F.col("n_sites").alias("numSites"), *(_six(F.get("patterns", F.lit(k))).alias(n) for k, n in enumerate(names)))


def ancestral_errors(counts: DataFrame, by_contig: bool = False) -> DataFrame:
    """One row for each sample (and contig): 125 counts by ancestral, reference and observed base (A, C, G, T, N), observed base fastest."""
    code = lambda c: F.when(F.col(c).between(0, 3), F.col(c)).otherwise(4)
    rows = counts.where(F.col("chr").isNotNull() if by_contig else F.col("chr").isNull()).withColumn("k", code("anc") * 25 + code("ref") * 5 + code("base"))
    keys = ["chr", "sample"] if by_contig else ["sample"]
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(125)))


def mismatches(counts: DataFrame) -> DataFrame:
    """``posi, isop, qs, strand, ref, obs, n``."""
    return counts.select("posi", "isop", "qs", F.col("is_rev").cast("int").alias("strand"), base_letter(F.col("ref")).alias("ref"), base_letter(F.col("base")).alias("obs"), "n")


def heteroplasmies(het: DataFrame) -> DataFrame:
    """``chr, pos, sample, depth, fA, fC, fG, fT, lrt``."""
    return het.select(*_place("chr", "pos"), "sample", "depth", *(_six(f"f{k}").alias(f"f{BASES[k]}") for k in range(4)), _six("lrt").alias("lrt"))


def depths(sites: DataFrame) -> DataFrame:
    """``chr, pos, totDepth`` of a table chr, pos, depth."""
    return sites.select(*_place("chr", "pos"), F.col("depth").alias("totDepth"))


def counts(table: DataFrame) -> DataFrame:
    """Counts with their place first; the columns stay as they are."""
    return table.select(*_place("chr", "pos"), *(c for c in table.columns if c not in ("chr", "pos")))


def quality_scores(histogram: DataFrame) -> DataFrame:
    """``qscore, counts``."""
    return histogram.select(F.col("qs").alias("qscore"), F.col("n").alias("counts"))


def depth_lines(histogram: DataFrame, most: int = 100) -> DataFrame:
    """One line of ``most + 1`` counts by depth for each sample (or for all): ``sample, value``."""
    keys = ["sample"] if "sample" in histogram.columns else []
    cells = [F.coalesce(F.sum(F.when(F.col("depth") == k, F.col("n_sites"))), F.lit(0)) for k in range(most + 1)]
    return histogram.groupBy(*keys).agg(F.concat_ws("\t", *cells).alias("value"))


def allele_frequencies(saf: DataFrame) -> DataFrame:
    """``chr, pos`` and the log likelihoods of all counts, one column each as one text."""
    return saf.select(*_place("chr", "pos"), F.array_join(F.transform("saf", lambda x: F.when(x == float("-inf"), "-inf").otherwise(F.format_string("%.6f", x))), "\t").alias("value"))


def thetas(table: DataFrame) -> DataFrame:
    """``Chromo, Pos, Watterson, Pairwise, thetaSingleton, thetaH, thetaL`` in logs."""
    names = {"tw": "Watterson", "tp": "Pairwise", "tf": "thetaSingleton", "th": "thetaH", "tl": "thetaL"}
    return table.select(*_place("Chromo", "Pos"), *(F.when(F.col(c) > 0, _six(F.log(c))).otherwise("-inf").alias(n) for c, n in names.items()))


def fixation(table: DataFrame) -> DataFrame:
    """``chr, pos, a, b``: numerator and denominator of the index of each position."""
    return table.select(*_place("chr", "pos"), _six("a").alias("a"), _six("b").alias("b"))


def psmc(table: DataFrame) -> DataFrame:
    """``chr, pos, sample, hom, het``."""
    return table.select(*_place("chr", "pos"), "sample", _six("hom").alias("hom"), _six("het").alias("het"))


def likelihoods(gl: DataFrame, samples: list, width: int = 10) -> DataFrame:
    """``chr, pos`` and ten log likelihoods a sample (or with width 3 those of major and minor: columns l0, l1, l2), flat ones where there are none."""
    if width == 10:
        value, none = F.transform("gl", lambda x: F.format_string("%.6f", x)), F.array_repeat(F.lit("0.000000"), 10)
    else:
        value, none = F.array(*(_six(F.log(F.greatest(f"l{k}", F.lit(1e-300)))) for k in range(3))), F.array_repeat(F.lit("0.000000"), 3)
    g, cells = _wide(gl, ["chr", "pos"], samples, value, none)
    return g.select(*_place("chr", "pos"), F.array_join(F.flatten(F.array(*cells)), "\t").alias("value"))


#: Result -> writer.
SINKS: dict[str, Callable[..., DataFrame]] = {
    "mafs": mafs, "geno": genotypes, "lrt": associations, "hwe": hardy_weinberg, "snpStat": statistics, "haplo": haploid, "tped": haploid_tped, "abbababa": abba_baba, "abbababa2": population_patterns,
    "ancError": ancestral_errors, "mismatch": mismatches, "hetGL": heteroplasmies, "pos": depths, "counts": counts, "scounts": counts, "qs": quality_scores, "depth": depth_lines,
    "saf": allele_frequencies, "thetas": thetas, "fst": fixation, "psmc": psmc, "glf": likelihoods,
}


# readers


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="NA")


def read_thetas(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos`` (0-based) ``, tw, tp, tf, th, tl`` on the linear scale."""
    t = _lines(spark, path)
    names = {"Watterson": "tw", "Pairwise": "tp", "thetaSingleton": "tf", "thetaH": "th", "thetaL": "tl"}
    return t.select(F.col("Chromo").alias("chr"), (F.col("Pos").cast("int") - 1).alias("pos"), *(F.when(F.col(n) == "-inf", 0.0).otherwise(F.exp(F.col(n).cast("double"))).alias(c) for n, c in names.items()))


def read_fixation(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos`` (0-based) ``, a, b``."""
    return _lines(spark, path).select("chr", (F.col("pos").cast("int") - 1).alias("pos"), *(F.col(c).cast("double").alias(c) for c in ("a", "b")))


def read_psmc(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos`` (0-based) ``, sample, hom, het``."""
    return _lines(spark, path).select("chr", (F.col("pos").cast("int") - 1).alias("pos"), F.col("sample").cast("bigint").alias("sample"), *(F.col(c).cast("double").alias(c) for c in ("hom", "het")))


def read_haploid(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos`` (0-based) ``, major, sample, base`` of called bases."""
    t = _lines(spark, path)
    own = [c for c in t.columns if c.startswith("ind")]
    cells = F.explode(F.array(*(F.struct(F.lit(int(c[3:])).alias("sample"), base_code(F.col(c)).alias("base")) for c in own))).alias("c")
    return t.select("chr", (F.col("pos").cast("int") - 1).alias("pos"), base_code(F.col("major")).alias("major"), cells).select("chr", "pos", "major", "c.*").where("base is not null")
