"""A builder that chains operators by name, checks what each one needs, and stays lazy; and the registry for own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators import association as A
from lociforge.operators import counting as C
from lociforge.operators import errors as X
from lociforge.operators import estimators as E
from lociforge.operators import likelihood as L
from lociforge.operators import models as M
from lociforge.operators import pairs as P
from lociforge.operators import quality as Q
from lociforge.operators import spectrum as S
from lociforge.sources.sinks import write_tsv
from lociforge.sources.tables import SINKS

#: name -> (what it needs, what it gives, function of the pipeline's tables and options)
OPERATORS: dict[str, tuple[tuple[str, ...], str, Callable]] = {}


def register_operator(name: str, needs: tuple[str, ...], gives: str, f: Callable[..., DataFrame]) -> None:
    """Adds an operator: ``f(*tables, **options)`` gets the tables in ``needs`` and its result is stored as ``gives``."""
    OPERATORS[name] = (needs, gives, f)


register_operator("filter_bases", ("reads",), "reads", C.mask_bases)
register_operator("cap_depth", ("reads",), "reads", C.cap_depth)
register_operator("counts", ("reads",), "counts", C.allele_counts)
register_operator("depth", ("reads",), "depth", C.site_depth)
register_operator("major_minor_counts", ("reads",), "alleles", lambda reads: C.major_minor(C.allele_counts(reads, ("chr", "pos"))))
register_operator("phat", ("counts", "alleles"), "freq", lambda counts, alleles, **o: C.phat(counts.join(alleles.select("chr", "pos", "major", "minor"), ["chr", "pos"]), **o))
register_operator("gl_gatk", ("reads",), "gl", L.gl_gatk)
register_operator("gl_dependent", ("reads",), "gl", M.gl_dependent)
register_operator("gl_calibrated", ("reads",), "gl", lambda reads: M.gl_calibrated(reads, M.calibration(reads)))
register_operator("gl_sampled", ("reads",), "gl", lambda reads, **o: L.gl_sampled(C.sampled_base(reads, **o)))
register_operator("major_minor", ("gl",), "alleles", lambda gl: L.best_pair(L.pair_scores(gl)))
register_operator("three", ("gl", "alleles"), "l3", L.three)
register_operator("frequency", ("l3",), "freq", lambda l3, **o: E.frequencies(L.collected(l3), **o))
register_operator("hwe", ("l3",), "hwe", lambda l3, **o: E.hardy_weinberg(L.collected(l3), **o))
register_operator("snp_filter", ("freq",), "freq", lambda freq, p=1e-6, min_maf=0.0: freq.where((F.col("lrt") >= E.chi2_threshold(p)) & F.col("freq").between(min_maf, 1 - min_maf)))
register_operator("posterior", ("l3", "freq"), "post", L.posterior)
register_operator("genotypes", ("post",), "geno", L.call_genotypes)
register_operator("saf", ("l3",), "saf", lambda l3, n, **o: E.allele_frequency_likelihoods(L.collected(l3), n, **o))
register_operator("haplo", ("reads",), "haplo", C.sampled_base)
register_operator("ibs", ("haplo",), "ibs", P.ibs_matrix)
register_operator("hwe_filter", ("hwe",), "hwe", E.hwe_filter)
register_operator("gate", ("geno", "counts", "alleles"), "geno", L.gate_genotypes)
register_operator("site_filter", ("counts",), "kept", C.site_filter)
register_operator("keep", ("reads", "kept"), "reads", C.keep_sites)
register_operator("regions", ("reads", "regions"), "reads", C.in_regions)
register_operator("effective_depth", ("reads",), "effective_depth", C.effective_depth)
register_operator("quality_histogram", ("reads",), "quality_histogram", C.quality_histogram)
register_operator("depth_histogram", ("reads",), "depth_histogram", C.depth_histogram)
register_operator("strand_counts", ("reads",), "strand_counts", C.strand_counts)
register_operator("mismatch", ("reads",), "mismatch", C.mismatch_matrix)
register_operator("ancestral_errors", ("reads",), "ancestral_errors", C.ancestral_errors)
register_operator("error_rates", ("ancestral_errors",), "error_rates", lambda counts: X.ancestral_error_rates(counts.where("chr is null")))
register_operator("quality_profile", ("reads",), "quality_profile", C.quality_profile)
register_operator("statistics", ("reads", "alleles"), "statistics", Q.site_statistics)
register_operator("statistic_filter", ("statistics",), "statistics", Q.statistic_filter)
register_operator("allele_models", ("gl", "alleles"), "models", lambda gl, alleles: M.allele_models(M.collected_gl(gl, alleles)))
register_operator("drop_triallelic", ("models",), "models", M.drop_triallelic)
register_operator("drop_transitions", ("freq",), "freq", L.drop_transitions)
register_operator("heteroplasmy", ("reads",), "heteroplasmy", M.heteroplasmy)
register_operator("psmc", ("gl",), "psmc", L.psmc_likelihoods)
register_operator("score_test", ("post", "pheno"), "lrt", A.score_test)
register_operator("regress", ("post", "pheno"), "lrt", A.regress)
register_operator("case_control", ("l3", "pheno"), "lrt", A.case_control)
register_operator("covariance", ("haplo", "alleles"), "covariance", P.sampled_covariance)
register_operator("posterior_covariance", ("post",), "covariance", P.posterior_covariance)
register_operator("abba_baba", ("haplo", "outgroup"), "abba_baba", P.abba_baba)
register_operator("population_frequencies", ("counts", "populations"), "pop_freq", P.population_frequencies)
register_operator("patterns", ("pop_freq",), "patterns", X.pattern_table)
register_operator("thetas", ("saf",), "thetas", lambda saf, sfs, n, **o: S.site_thetas(S.site_posterior(saf, sfs), n, **o))
register_operator("theta_windows", ("thetas",), "theta_windows", S.window_thetas)
register_operator("consensus", ("haplo", "contigs"), "consensus", C.consensus_lines)


class Pipeline:
    """``Pipeline(reads=df).run("gl_gatk").run("major_minor").run("three").run("frequency")["freq"]``.

    Nothing is computed before a result is used; steps that aren't needed for it cost nothing.
    """

    def __init__(self, **tables: DataFrame) -> None:
        self.tables = dict(tables)
        self.log: list[tuple[str, dict]] = []

    def run(self, name: str, **options) -> Pipeline:
        needs, gives, f = OPERATORS[name]
        if missing := [t for t in needs if t not in self.tables]:
            makers = {t: sorted(k for k, v in OPERATORS.items() if v[1] == t) for t in missing}
            raise ValueError(f"{name} needs {missing}; run one of {makers} first")
        self.tables[gives] = f(*(self.tables[t] for t in needs), **options)
        self.log.append((name, options))
        return self

    def write(self, table: str, sink: str, path: str | None, *keys: str, **options) -> Pipeline:
        """Writes a table as the text of ``sink``; without a path nothing is written, for steps that only serve as filters."""
        if path is not None:
            write_tsv(SINKS[sink](self.tables[table], **options), path, *keys)
        return self

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]
