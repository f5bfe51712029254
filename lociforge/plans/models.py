"""Queries of the order-dependent models, quality statistics and whole-data estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators import counting as C
from lociforge.operators import iterative as I
from lociforge.operators import likelihood as L
from lociforge.operators import models as M
from lociforge.operators import quality as Q
from lociforge.operators import spectrum as S
from lociforge.operators.coalescent import decode
from lociforge.functions.genotypes import GENOTYPES
from lociforge.plans.genetics import _BEST, _GL, NEUTRAL, _alleles, _gl, _l3, _saf, _sites, rounded
from lociforge.plans.pileup import CTE, SAMPLES, pileup

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, directory) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ten(g: DataFrame, digits: int = 4) -> DataFrame:
    return rounded(g.select("chr", "pos", "sample", *(F.element_at("gl", i + 1).alias(f"g{i}") for i in range(10))), *(f"g{i}" for i in range(10)), digits=digits)


_TEN = "[" + ", ".join(f"sum(ln((p[{a + 1}] + p[{b + 1}]) / 2))" for a, b in GENOTYPES) + "]"
_TEN_OUT = "select chr, pos, sample, " + ", ".join(f"round(g[{i + 1}] - list_max(g), 4) + 0 as g{i}" for i in range(10)) + " from g0"


def _tail(k: str) -> str:
    """SQL of the chance of at least k errors among n bases of error rate e."""
    return f"list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(e) + (n - i) * ln(1 - e))))"


def _dependent(a: int, b: int) -> str:
    """SQL of a genotype's log likelihood from the summed costs t and the counts c of the bases."""
    cost = " + ".join(f"t[{k + 1}]" for k in range(4) if k not in (a, b))
    if a != b:
        m = f"c[{a + 1}] + c[{b + 1}]"
        cost += f" - 10 / ln(10) * (lgamma({m} + 1) - lgamma(c[{a + 1}] + 1) - lgamma(c[{b + 1}] + 1) - ({m}) * ln(2))"
    return f"-greatest({cost}, 0) * ln(10) / 10"


@query(CTE + f""", x as (select chr, pos, sample, base, is_rev, ord, greatest(4, least(63, qs, mapq)) as q, count(*) over (partition by chr, pos, sample) as n from r where qs >= 13 and base between 0 and 3),
y as (select *, pow(10, -q / 10.0) as e, row_number() over (partition by chr, pos, sample, base, is_rev order by q desc, ord) - 1 as again, row_number() over (partition by chr, pos, sample, base order by q desc, is_rev desc, ord) - 1 as k from x),
z as (select chr, pos, sample, base, (pow(0.83, again) * 0.97 + 0.03) * -10 * log10({_tail("k + 1")} / {_tail("k")}) as cost from y),
w as (select chr, pos, sample, [{", ".join(f"coalesce(sum(cost) filter (base = {b}), 0)" for b in range(4))}] as t, [{", ".join(f"count(*) filter (base = {b})" for b in range(4))}] as c from z group by all),
g0 as (select chr, pos, sample, [{", ".join(_dependent(a, b) for a, b in GENOTYPES)}] as g from w) """ + _TEN_OUT)
def gl_dependent_errors(spark: SparkSession, d: str) -> DataFrame:
    return _ten(M.gl_dependent(pileup(spark, d)))


@query(CTE + """, c as (select qs, case when is_rev then isop else posi end as cycle, ref, count(*) filter (base = 0) as a, count(*) filter (base = 1) as c, count(*) filter (base = 2) as g, count(*) filter (base = 3) as t from r group by all)
select qs, cycle, ref, round((a + 1) / (a + c + g + t + 4), 6) as p0, round((c + 1) / (a + c + g + t + 4), 6) as p1, round((g + 1) / (a + c + g + t + 4), 6) as p2, round((t + 1) / (a + c + g + t + 4), 6) as p3 from c""")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.calibration(pileup(spark, d)), "p0", "p1", "p2", "p3", digits=6)


@query(CTE + f""", x as (select *, case when is_rev then isop else posi end as cycle from r),
c as (select qs, cycle, ref, [(count(*) filter (base = b) + 1) / (count(*) + 4.0) for b in [0, 1, 2, 3]] as p from x group by all)
select 1""".replace("[(count(*) filter (base = b) + 1) / (count(*) + 4.0) for b in [0, 1, 2, 3]]", "[" + ", ".join(f"(count(*) filter (base = {b}) + 1) / (count(*) + 4.0)" for b in range(4)) + "]").replace("select 1", f"""
, w as (select qs, cycle, {", ".join(f"any_value(p) filter (ref = {a}) as c{a}" for a in range(4))} from c group by all),
y as (select chr, pos, sample, [{", ".join(f"coalesce(c{a}[base + 1], 0.25)" for a in range(4))}] as p from x join w using (qs, cycle)),
g0 as (select chr, pos, sample, {_TEN} as g from y group by all) """ + _TEN_OUT))
def gl_calibrated(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    return _ten(M.gl_calibrated(r, M.calibration(r)))


@query(CTE + " select least(posi, isop) as place, posi <= isop as five_prime, is_rev, qs // 5 as qbin, anc, ref, base, count(*) as n from r group by all")
def outgroup_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.outgroup_counts(pileup(spark, d)).withColumn("qbin", F.col("qbin").cast("int"))


@query(CTE + """, s as (select least(posi, isop) as place, posi <= isop as five_prime, is_rev, (qs // 5)::int as qbin, ref, base, count(*) as n from r where anc = ref group by all)
select place, five_prime, is_rev, qbin, ref, base, round((n + 1) / (sum(n) over (partition by place, five_prime, is_rev, qbin, ref) + 4), 5) as rate from s""")
def outgroup_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.outgroup_rates(M.outgroup_counts(pileup(spark, d))), "rate").withColumn("qbin", F.col("qbin").cast("int"))


@query()
def allele_models(spark: SparkSession, d: str) -> DataFrame:
    gl = _gl(spark, d)
    return rounded(M.allele_models(M.collected_gl(gl, _alleles(gl))).drop("lik"), "unknown_em", "f0", "f1", "f2", "f3", "tri_lrt", "tri_p", digits=4)


def _rank(v: str, name: str) -> str:
    """SQL of one rank test from its histogram."""
    return f"""{name}h as (select chr, pos, {v} as v, count(*) filter (not is_minor) as m1, count(*) filter (is_minor) as m2 from x group by all),
{name}w as (select *, coalesce(sum(m1) over w, 0) as b1, coalesce(sum(m2) over w, 0) as b2 from {name}h window w as (partition by chr, pos order by v rows between unbounded preceding and 1 preceding)),
{name} as (select chr, pos, (least(sum(m2 * (m1 / 2 + b1)), sum(m1 * (m2 / 2 + b2))) - sum(m1) * sum(m2) / 2.0) / nullif(sqrt(sum(m1) * sum(m2) * (sum(m1) + sum(m2) + 1) / 12.0), 0) as z from {name}w group by all)"""


@query(_BEST + f""", x as (select r.*, r.base <> major as is_minor from r join mm on mm.chr = r.chr and mm.pos = r.pos where r.base in (major, minor)),
{_rank("qs", "zq")}, {_rank("mapq", "zm")}, {_rank("least(posi, isop)", "ze")},
s as (select chr, pos, count(*) filter (not is_minor and not is_rev) as a, count(*) filter (is_minor and not is_rev) as b, count(*) filter (not is_minor and is_rev) as c, count(*) filter (is_minor and is_rev) as d from x group by all)
select s.chr, s.pos, a as n_major_fwd, b as n_minor_fwd, c as n_major_rev, d as n_minor_rev, round((b / nullif(a + b, 0) - d / nullif(c + d, 0)) / nullif((b + d) / (a + b + c + d), 0), 5) + 0 as sb1,
round(zq.z, 5) + 0 as z_qs, round(zm.z, 5) + 0 as z_mapq, round(ze.z, 5) + 0 as z_edge from s join zq using (chr, pos) join zm using (chr, pos) join ze using (chr, pos)""")
def site_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    s = Q.site_statistics(r, M.likelihood_sites(L.gl_gatk(r)))
    return rounded(s.drop("sb2", "sb3_p"), "sb1", "z_qs", "z_mapq", "z_edge")


@query()
def site_statistics_exact(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    sites = M.likelihood_sites(L.gl_gatk(r))
    hets = L.call_genotypes(L.posterior(M.long_likelihoods(sites)), 0.9).where("geno = 1")
    return rounded(Q.site_statistics(r, sites, hets).select("chr", "pos", "sb2", "sb3_p", "het_bias_p"), "sb2", "sb3_p", "het_bias_p")


@query(_GL + """, p as (select chr, pos, sample, ln((exp(g[1]) + exp(g[5]) + exp(g[8]) + exp(g[10])) / 4) as hom, ln((exp(g[2]) + exp(g[3]) + exp(g[4]) + exp(g[6]) + exp(g[7]) + exp(g[9])) / 6) as het from g)
select chr, pos, sample, round(hom, 5) + 0 as hom, round(het, 5) + 0 as het from p""")
def psmc_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.psmc_likelihoods(_gl(spark, d)), "hom", "het")


_D = "exp(het - hom) - 1"


@query(_GL + f""", p as (select chr, pos, sample, ln((exp(g[1]) + exp(g[5]) + exp(g[8]) + exp(g[10])) / 4) as hom, ln((exp(g[2]) + exp(g[3]) + exp(g[4]) + exp(g[6]) + exp(g[7]) + exp(g[9])) / 6) as het from g),
d as (select sample, list({_D}) as d from p group by sample),
b as (select sample, list_reduce(range(60), lambda s, i: case when list_sum(list_transform(d, lambda v: v / (1 + (s[1] + s[2]) / 2 * v))) > 0 then [(s[1] + s[2]) / 2, s[2]] else [s[1], (s[1] + s[2]) / 2] end, [0.0::double, 1.0::double]) as s from d)
select sample, chr, pos // 100 as win, count(*) as n_sites, bool_or(exp(het) * s[1] / (exp(het) * s[1] + exp(hom) * (1 - s[1])) > 0.9) as is_het from p join b using (sample) group by all""")
def psmc_windows(spark: SparkSession, d: str) -> DataFrame:
    p = L.psmc_likelihoods(_gl(spark, d))
    return I.heterozygous_windows(p, I.heterozygosity(p))


@query()
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    e = I.error_rates(C.allele_counts(pileup(spark, d)), 30)
    return spark.createDataFrame([(i, j, round(float(e[i, j]), 5)) for i in range(4) for j in range(4)], "true_base int, seen_base int, rate double")


@query()
def genotype_spectrum_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = I.genotype_spectra_of_pairs(_gl(spark, d), SAMPLES)
    return spark.createDataFrame([(a, b, i, j, round(float(x[i, j]), 5)) for (a, b), x in f.items() for i in range(10) for j in range(10)], "sample1 int, sample2 int, g1 int, g2 int, freq double")


@query()
def admixture_shares(spark: SparkSession, d: str) -> DataFrame:
    q, _, _ = I.admixture(I.informative_sites(I.full_sites(_l3(spark, d), SAMPLES), 10), 10, 2)
    return spark.createDataFrame([(s, k, round(float(q[s, k]), 4)) for s in SAMPLES for k in range(2)], "sample int, k int, share double")


@query(CTE + """, c as (select pos, count(*) as d, greatest(count(*) filter (base = 0), count(*) filter (base = 1), count(*) filter (base = 2), count(*) filter (base = 3)) as m from r group by pos),
s as (select p_partkey as snp, 0.1 + (p_partkey % 7) / 20.0 as freq from part where p_partkey % 9 = 4),
n as (select snp, freq, unnest(range(snp - 4, snp + 5)) as pos from s), j as (select snp, freq, d, d - m as o, n.pos = snp as here from n join c using (pos))
select snp, round(freq, 4) as freq, sum(d) filter (here)::bigint as depth, sum(o) filter (here)::bigint as other, sum(d) filter (not here)::bigint as flank_depth, sum(o) filter (not here)::bigint as flank_other from j group by snp, freq having count(*) = 9""")
def contamination_sites(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_contamination(spark, d), "freq", digits=4)


def _contamination(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    snps = r.select("pos").distinct().where("pos % 9 = 4").withColumn("freq", 0.1 + (F.col("pos") % 7) / 20.0)
    return I.contamination_sites(C.allele_counts(r, ("pos",)), snps)


@query(CTE + """, c as (select pos, count(*) as d, greatest(count(*) filter (base = 0), count(*) filter (base = 1), count(*) filter (base = 2), count(*) filter (base = 3)) as m from r group by pos),
s as (select p_partkey as snp, 0.1 + (p_partkey % 7) / 20.0 as freq from part where p_partkey % 9 = 4),
n as (select snp, freq, unnest(range(snp - 4, snp + 5)) as pos from s), j as (select snp, freq, d, d - m as o, n.pos = snp as here from n join c using (pos)),
x as (select freq, sum(d) filter (here)::double as depth, sum(o) filter (here)::double as other, sum(d) filter (not here)::double as fd, sum(o) filter (not here)::double as fo from j group by snp, freq having count(*) = 9),
t as (select sum(fo) / sum(fd) as eps, sum(fo) as so, sum(fd) as sd, sum(freq) as sf, sum(other / depth) as sr, count(*) as n, list({'f': freq, 'd': depth, 'o': other}) as k from x),
l as (select (so - fo) / (sd - fd) as e, ((sr - other / depth) / (n - 1) - (so - fo) / (sd - fd)) / ((sf - freq) / (n - 1) * (1 - 4 * (so - fo) / (sd - fd) / 3)) as one from x, t),
v as (select var_pop(one) as v from l),
b as (select list_reduce(range(60), lambda s, i: case when list_sum(list_transform(k, lambda q: (q.o / ((s[1] + s[2]) / 2 * q.f * (1 - 4 * eps / 3) + eps) - (q.d - q.o) / (1 - (s[1] + s[2]) / 2 * q.f * (1 - 4 * eps / 3) - eps)) * q.f)) > 0
  then [(s[1] + s[2]) / 2, s[2]] else [s[1], (s[1] + s[2]) / 2] end, [1e-6::double, 0.5::double]) as s from t)
select round(eps, 4) as eps, round((sr / n - eps) / (sf / n * (1 - 4 * eps / 3)), 4) as estimate, round(sqrt(v * (n - 1)), 4) as se, n as n_sites, round(s[1], 4) as ml from t, v, b""")
def contamination_estimate(spark: SparkSession, d: str) -> DataFrame:
    s = _contamination(spark, d)
    ml = I.contamination_likelihood(s)
    return rounded(I.contamination_moments(s).withColumn("ml", F.lit(ml)), "eps", "estimate", "se", "ml", digits=4)


_STRATA = "least(posi, isop) as place, posi <= isop as five_prime, is_rev, (qs // 5)::int as qbin"


@query(CTE + f""", s as (select {_STRATA}, ref, base, count(*) as n from r where anc = ref group by all),
t as (select place, five_prime, is_rev, qbin, ref, base, (n + 1) / (sum(n) over (partition by place, five_prime, is_rev, qbin, ref) + 4) as rate from s),
w as (select place, five_prime, is_rev, qbin, {", ".join(f"any_value(rate) filter (ref = {a} and base = {b}) as r{a}{b}" for a in range(4) for b in range(4))} from t group by all),
x as (select chr, pos, sample, base, qs, {_STRATA} from r),
y as (select chr, pos, sample, [{", ".join(f"coalesce([{', '.join(f'r{a}{b}' for b in range(4))}][base + 1], case when base = {a} then 1 - pow(10.0, -qs / 10.0) else pow(10.0, -qs / 10.0) / 3 end)" for a in range(4))}] as p from x left join w using (place, five_prime, is_rev, qbin)),
g0 as (select chr, pos, sample, {_TEN} as g from y group by all) """ + _TEN_OUT)
def gl_outgroup(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    return _ten(M.gl_outgroup(r, M.outgroup_rates(M.outgroup_counts(r))))


@query()
def allele_set_calls(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    ref = r.groupBy("chr", "pos").agg(F.max("ref").alias("major"))
    return rounded(M.allele_set_calls(M.collected_gl(L.gl_gatk(r), ref)), "qual", digits=3)


@query()
def coalescence_times(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decode(psmc_windows(spark, d), 12, by=("sample", "chr")), "mean_time")
