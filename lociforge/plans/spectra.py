"""Queries of spectra, Hardy-Weinberg tests and filters in forms that plain SQL can follow step by step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.genotypes import GENOTYPES, harmonic
from lociforge.operators import association as A
from lociforge.operators import counting as C
from lociforge.operators import errors as X
from lociforge.operators import estimators as E
from lociforge.operators import likelihood as L
from lociforge.operators import models as M
from lociforge.operators import pairs as P
from lociforge.operators import spectrum as S
from lociforge.plans.counting import _COUNTS
from lociforge.plans.genetics import _BEST, _EM, _GL, _LUT, _THREE, NEUTRAL, ROUNDS, _alleles, _freq, _gl, _l3, _pheno, _saf, _sites, rounded
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


# SQL of spectra: likelihoods (a, b, c) of each sample in turn take the counts' likelihoods h one sample further


def _steps(ls: str, n: int, ploidy: int = 2) -> str:
    """Log likelihoods, relative to the largest, of 0 to ploidy * n copies, from a list of n structs a, b, c."""
    k = ploidy * n
    at = "case when i >= {0} then h[(i + 1 - {0})::bigint] else 0 end"
    step = f"h[i + 1] * x.a + {at.format(1)} * 2 * x.b + {at.format(2)} * x.c" if ploidy == 2 else f"h[i + 1] * x.a + {at.format(1)} * x.c"
    ways = [math.lgamma(k + 1) - math.lgamma(j + 1) - math.lgamma(k - j + 1) for j in range(k + 1)]
    h = f"list_reduce({ls}, lambda h, x: list_transform(range({k + 1}), lambda i: {step}), list_transform(range({k + 1}), lambda i: case when i = 0 then 1.0 else 0.0 end::double))"
    return f"list_transform({h}, lambda v, i: ln(v) - {ways!r}[i])"


def _saf_sql(name: str, samples: list[int], ploidy: int = 2) -> str:
    """Common table expressions after ``_THREE``: ``name`` with chr, pos and s, the log likelihoods relative to the largest."""
    flat = "{'a': 1.0::double, 'b': 1.0::double, 'c': 1.0::double}"
    return f""", {name}_l as (select chr, pos, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) as ls, count(*) as k from l where sample in ({", ".join(map(str, samples))}) group by all),
{name}_s as (select chr, pos, {_steps(f"list_concat(ls, list_transform(range({len(samples)} - k), lambda i: {flat}))", len(samples), ploidy)} as s from {name}_l),
{name} as (select chr, pos, list_transform(s, lambda v: v - list_max(s)) as s from {name}_s)"""


@query(_THREE + _saf_sql("sf", SAMPLES) + " select chr, pos, unnest(range(21))::int as bin, round(unnest(s), 4) + 0 as value from sf")
def saf_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    s = _saf(spark, d, SAMPLES)
    return s.select("chr", "pos", F.posexplode("saf").alias("bin", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(_THREE + _saf_sql("sf", SAMPLES, 1) + " select chr, pos, unnest(range(11))::int as bin, round(unnest(s), 4) + 0 as value from sf")
def saf_haploid(spark: SparkSession, d: str) -> DataFrame:
    s = E.allele_frequency_likelihoods(_sites(spark, d), len(SAMPLES), haploid=True)
    return s.select("chr", "pos", F.posexplode("saf").alias("bin", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


_PRIOR = (NEUTRAL / NEUTRAL.sum()).tolist()
_I = np.arange(21)
_WEIGHTS = {
    "tw": np.where((_I > 0) & (_I < 20), 1 / harmonic(20), 0), "tp": _I * (20 - _I) / 190, "tf": (_I == 1) * 1.0,
    "th": ((_I > 0) & (_I < 20)) * _I * _I / 190, "tl": ((_I > 0) & (_I < 20)) * _I / 19,
}
_POSTERIOR = f", u as (select chr, pos, list_transform(s, lambda v, i: exp(v) * {_PRIOR!r}[i]) as w from sf), q as (select chr, pos, list_transform(w, lambda v: v / list_sum(w)) as q from u)"


@query(_THREE + _saf_sql("sf", SAMPLES) + _POSTERIOR + " select chr, pos, " + ", ".join(f"round(list_sum(list_transform(q, lambda v, i: v * {w.tolist()!r}[i])), 5) + 0 as {k}" for k, w in _WEIGHTS.items()) + " from q")
def saf_thetas(spark: SparkSession, d: str) -> DataFrame:
    t = S.site_thetas(S.site_posterior(_saf(spark, d, SAMPLES), NEUTRAL), 20)
    return rounded(t, "tw", "tp", "tf", "th", "tl")


def _em_sql(rounds: int) -> str:
    """Plain EM of a spectrum over table t, round by round."""
    out = ", b as (select chr, pos, unnest(range(21))::int as bin, exp(unnest(s)) as v from sf), f0 as (select bin, 1.0 / 21 as f from (select unnest(range(21))::int as bin))"
    for k in range(rounds):
        out += f", e{k} as (select bin, v * f / sum(v * f) over (partition by chr, pos) as p from b join f{k} using (bin)), f{k + 1} as (select bin, avg(p) as f from e{k} group by bin)"
    return out


@query(_THREE + _saf_sql("sf", SAMPLES) + _em_sql(6) + " select bin, round(f * (select count(*) from sf), 4) as value from f6")
def sfs_em_steps(spark: SparkSession, d: str) -> DataFrame:
    sfs = S.estimate_spectrum([_saf(spark, d, SAMPLES)], (21,), rounds=6, tol=0.0, method="em")
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(sfs)], "bin int, value double")


def _fold_em_sql(rounds: int) -> str:
    to, weight = S.fold_map((21,))
    out = f", b0 as (select chr, pos, unnest(range(21))::int as bin, exp(unnest(s)) as v from sf), b as (select chr, pos, {to.tolist()!r}[bin + 1] as bin, sum(v * {weight.tolist()!r}[bin + 1]) as v from b0 group by all), f0 as (select bin, (case when bin = 10 then 1.0 else 2.0 end) / 21 as f from (select unnest(range(11)) as bin))"
    for k in range(rounds):
        out += f", e{k} as (select bin, v * f / sum(v * f) over (partition by chr, pos) as p from b join f{k} using (bin)), f{k + 1} as (select bin, avg(p) as f from e{k} group by bin)"
    return out


@query(_THREE + _saf_sql("sf", SAMPLES) + _fold_em_sql(6) + " select bin::int as bin, round(f * (select count(*) from sf), 4) as value from f6")
def sfs_em_folded_steps(spark: SparkSession, d: str) -> DataFrame:
    sfs = S.estimate_spectrum([_saf(spark, d, SAMPLES)], (21,), rounds=6, tol=0.0, method="em", folded=True)
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(sfs[:11])], "bin int, value double")


_GROUPS = [SAMPLES[:3], SAMPLES[3:6], SAMPLES[6:]]


def _ab_sql(name: str, x: str, y: str, n1: int, n2: int, kind: str = "reynolds") -> str:
    """Expected numerator and denominator of the fixation index of each position under a flat joint spectrum."""
    a, b = (v.reshape(n1 + 1, n2 + 1).tolist() for v in S.fst_coefficients(n1, n2, kind))
    total = "(list_sum(list_transform(x.s, lambda v: exp(v))) * list_sum(list_transform(y.s, lambda v: exp(v))))"
    part = lambda c: f"list_sum(list_transform(x.s, lambda v, i: exp(v) * list_sum(list_transform(y.s, lambda w, j: exp(w) * {c!r}[i][j])))) / {total}"
    return f", {name} as (select x.chr, x.pos, {part(a)} as a, {part(b)} as b from {x} x join {y} y on x.chr = y.chr and x.pos = y.pos)"


_PAIRWISE = "".join(_saf_sql(f"pop{i}", g) for i, g in enumerate(_GROUPS)) + _ab_sql("ab01", "pop0", "pop1", 6, 6) + _ab_sql("ab02", "pop0", "pop2", 6, 8) + _ab_sql("ab12", "pop1", "pop2", 6, 8)


@query(_THREE + _PAIRWISE + """, w as (select (select sum(a) / sum(b) from ab01) as f01, (select sum(a) / sum(b) from ab02) as f02, (select sum(a) / sum(b) from ab12) as f12),
z as (select *, -ln(1 - f01) as t01, -ln(1 - f02) as t02, -ln(1 - f12) as t12 from w)
select 0 as pop, round(f01, 5) as fst, round((t01 + t02 - t12) / 2, 5) as pbs from z union all select 1, round(f02, 5), round((t01 + t12 - t02) / 2, 5) from z union all select 2, round(f12, 5), round((t02 + t12 - t01) / 2, 5) from z""")
def branch_statistics(spark: SparkSession, d: str) -> DataFrame:
    safs = [_saf(spark, d, g) for g in _GROUPS]
    out = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        n1, n2 = 2 * len(_GROUPS[i]), 2 * len(_GROUPS[j])
        out.append(S.fst_summary(S.fst_sites(safs[i], safs[j], np.ones((n1 + 1) * (n2 + 1)), n1, n2)).first()["fst_weighted"])
    return spark.createDataFrame([(k, round(float(f), 5), round(float(b), 5)) for k, (f, b) in enumerate(zip(out, S.branch_statistics(*out)))], "pop int, fst double, pbs double")


@query(_THREE + _saf_sql("x0", SAMPLES[:4]) + _saf_sql("y0", SAMPLES[4:]) + _ab_sql("ab", "x0", "y0", 8, 12, "hudson") + """,
e as (select chr, (min(pos) // 100) * 100 + 100 as o, max(pos) as z from ab group by chr), w as (select chr, unnest(range(o, z - 500 + 1, 100)) as s from e)
select w.chr, s as win_start, s + 500 as win_stop, round(avg(a / b), 5) + 0 as fst_unweighted, round(sum(a) / sum(b), 5) + 0 as fst_weighted, count(*) as n_sites from w join ab on ab.chr = w.chr and pos >= s and pos < s + 500 group by w.chr, s""")
def fst_windows_flat(spark: SparkSession, d: str) -> DataFrame:
    ab = S.fst_sites(_saf(spark, d, SAMPLES[:4]), _saf(spark, d, SAMPLES[4:]), np.ones(9 * 13), 8, 12, "hudson")
    return rounded(S.fst_windows(ab, 500, 100), "fst_unweighted", "fst_weighted")


@query(_THREE + _saf_sql("x0", SAMPLES[:4]) + _saf_sql("y0", SAMPLES[4:]) + """, m as (select x.chr, x.pos, list_position(x.s, list_max(x.s)) - 1 as bin0, list_position(y.s, list_max(y.s)) - 1 as bin1 from x0 x join y0 y on x.chr = y.chr and x.pos = y.pos)
select chr, pos, bin0::int as bin0, bin1::int as bin1 from m where not (bin0 = 0 and bin1 = 0) and not (bin0 = 8 and bin1 = 12)""")
def variable_sites(spark: SparkSession, d: str) -> DataFrame:
    groups = [SAMPLES[:4], SAMPLES[4:]]
    return S.variable_sites([_saf(spark, d, g) for g in groups], [np.ones(2 * len(g) + 1) for g in groups])


def _any_minor_sql() -> str:
    """Three runs over the ten likelihoods, one for each minor allele beside the ancestral one."""
    parts = []
    for k in range(3):
        minor = f"[{', '.join(str([x for x in range(4) if x != m][k]) for m in range(4))}][m + 1]"
        pick = lambda a, b: f"exp(g[{_LUT}[{a} + 1][{b} + 1]])"
        parts.append(f"list({{'a': {pick('m', 'm')}, 'b': {pick('m', minor)}, 'c': {pick(minor, minor)}}} order by sample) as m{k}")
    flat = "{'a': 1.0::double, 'b': 1.0::double, 'c': 1.0::double}"
    runs = ", ".join(_steps(f"list_concat(m{k}, list_transform(range(10 - k), lambda i: {flat}))", 10) + f" as s{k}" for k in range(3))
    return f""", an as (select chr, pos, max(anc) as m from r group by all), gm as (select g.chr, g.pos, m, {", ".join(parts)}, count(*) as k from g join an using (chr, pos) where list_max(g) - list_min(g) > 1e-9 group by all),
sm as (select chr, pos, {runs} from gm), tm as (select chr, pos, list_transform(s0, lambda v, i: ln(exp(v) + exp(s1[i]) + exp(s2[i]))) as s from sm)"""


@query(_GL + _any_minor_sql() + " select chr, pos, unnest(range(21))::int as bin, round(unnest(list_transform(s, lambda v: v - list_max(s))), 4) + 0 as value from tm")
def saf_any_minor(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    anc = r.groupBy("chr", "pos").agg(F.max("anc").alias("major"))
    s = M.saf_any_minor(L.gl_gatk(r), anc, 10)
    return s.select("chr", "pos", F.posexplode("saf").alias("bin", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


# Hardy-Weinberg

_HWE = 25
_W3 = "x.a * ((1 - {p}) * (1 - {p}) + {p} * (1 - {p}) * {f})", "x.b * (2 * {p} * (1 - {p}) - 2 * {p} * (1 - {p}) * {f})", "x.c * ({p} * {p} + {p} * (1 - {p}) * {f})"


def _hwe_sql() -> str:
    w = [x.format(p="v.p", f="v.f") for x in _W3]
    mean = lambda k: f"greatest(list_avg(list_transform(ls, lambda x: ({w[k]}) / (({w[0]}) + ({w[1]}) + ({w[2]})))), 1e-4)"
    lik = lambda p, f: "list_sum(list_transform(ls, lambda x: ln(" + " + ".join(x.format(p=p, f=f) for x in _W3) + ")))"
    p0 = f"list_reduce(range({_HWE}), lambda p, i: list_avg(list_transform(ls, lambda x: (x.b * 2 * p * (1 - p) + 2 * x.c * p * p) / (2 * (x.a * (1 - p) * (1 - p) + x.b * 2 * p * (1 - p) + x.c * p * p)))), 0.1::double)"
    turn = f"list_transform([[{mean(0)}, {mean(1)}, {mean(2)}]], lambda g: {{'p': (g[2] / 2 + g[3]) / list_sum(g), 'f': 1 - (g[2] / list_sum(g)) / (2 * ((g[2] / 2 + g[3]) / list_sum(g)) * (1 - (g[2] / 2 + g[3]) / list_sum(g)))}})[1]"
    return f""", h0 as (select chr, pos, major, minor, ls, {p0} as p0 from ls), h1 as (select *, list_reduce(range({_HWE}), lambda v, i: {turn}, {{'p': least(greatest(p0, 1e-4), 1 - 1e-4), 'f': 0.05::double}}) as v from h0),
h as (select chr, pos, major, minor, p0 as hwe_freq, v.p as freq, v.f as f, 2 * ({lik('v.p', 'v.f')} - {lik('p0', '0')}) as lrt, 2 * (1 - v.f) * v.p * (1 - v.p) as het_freq from h1)"""


_HW = _THREE + ", ls as (select chr, pos, major, minor, list({'a': l0, 'b': l1, 'c': l2} order by sample) as ls from l group by all)" + _hwe_sql()


def _hw(spark: SparkSession, d: str) -> DataFrame:
    return E.hardy_weinberg(_sites(spark, d), _HWE, 0.0)


@query(_HW + " select chr, pos, major, minor, round(hwe_freq, 4) + 0 as hwe_freq, round(freq, 4) + 0 as freq, round(f, 3) + 0 as f, round(lrt, 3) + 0 as lrt, round(het_freq, 4) + 0 as het_freq from h")
def hwe_test(spark: SparkSession, d: str) -> DataFrame:
    h = _hw(spark, d).select("chr", "pos", "major", "minor", "hwe_freq", "freq", "f", "lrt", "het_freq")
    return rounded(rounded(h, "hwe_freq", "freq", "het_freq", digits=4), "f", "lrt", digits=3)


@query(_HW + f" select chr, pos from h where greatest(lrt, 0) < {E.chi2_threshold(0.05)!r} and het_freq between 0.1 and 0.6")
def filter_hwe(spark: SparkSession, d: str) -> DataFrame:
    return E.hwe_filter(_hw(spark, d), min_p=0.05, min_het=0.1, max_het=0.6).select("chr", "pos")


# posteriors and filters


@query(_EM + """, pn as (select chr, pos, (pos * 7) % 11 as ac, 10 + pos % 5 as an from f), k as (select chr, pos, count(*) as keep from l group by all),
m as (select f.chr, f.pos, (ac + freq * keep) / (an + keep) as q from f join pn using (chr, pos) join k using (chr, pos)),
po as (select l.chr, l.pos, l.sample, l0 * (1 - q) * (1 - q) as a, l1 * 2 * q * (1 - q) as b, l2 * q * q as c from l join m using (chr, pos))
select chr, pos, sample, round(a / (a + b + c), 4) + 0 as p0, round(b / (a + b + c), 4) + 0 as p1, round(c / (a + b + c), 4) + 0 as p2 from po where a + b + c > 0""")
def posterior_panel(spark: SparkSession, d: str) -> DataFrame:
    f = _freq(spark, d, True)
    panel = f.select("chr", "pos", ((F.col("pos") * 7) % 11).alias("ac"), (10 + F.col("pos") % 5).alias("an"))
    post = L.panel_posterior(M.long_likelihoods(f), panel, f)
    return rounded(post.select("chr", "pos", "sample", "p0", "p1", "p2"), "p0", "p1", "p2", digits=4)


@query(_THREE + "select chr, pos, round(avg((l1 + 2 * l2) / (l0 + l1 + l2)) / 2, 5) + 0 as freq, count(*) as n from l group by all")
def maf_posterior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.posterior_frequency(L.posterior(_l3(spark, d))), "freq")


@query(f"""{_THREE}, li as (select chr, pos, sample, l0 as a, l1 as b, l2 as c, (sample % 4) / 5.0 as k from l), ls as (select chr, pos, list({{'a': a, 'b': b, 'c': c, 'k': k}} order by sample) as ls from li group by all)
select chr, pos, round(list_reduce(range({ROUNDS}), lambda p, i: list_avg(list_transform(ls, lambda x: (x.b * (2 * p * (1 - p) - 2 * p * (1 - p) * x.k) + 2 * x.c * (p * p + p * (1 - p) * x.k))
 / (2 * (x.a * ((1 - p) * (1 - p) + p * (1 - p) * x.k) + x.b * (2 * p * (1 - p) - 2 * p * (1 - p) * x.k) + x.c * (p * p + p * (1 - p) * x.k))))), 0.001::double), 4) + 0 as freq from ls""")
def maf_inbred(spark: SparkSession, d: str) -> DataFrame:
    people = spark.createDataFrame([(s, (s % 4) / 5.0) for s in SAMPLES], "sample bigint, inbreeding double")
    return rounded(E.inbred_frequencies(_l3(spark, d), people, ROUNDS, 0.0).select("chr", "pos", "freq"), "freq", digits=4)


@query(CTE + ", q as (select *, case when qs < 15 + sample * 2 then 4 else base end as b2 from r) select chr, pos, sample, count(*) filter (b2 = 0) as n_a, count(*) filter (b2 = 1) as n_c, count(*) filter (b2 = 2) as n_g, count(*) filter (b2 = 3) as n_t from q group by all")
def filter_sample_quality(spark: SparkSession, d: str) -> DataFrame:
    cutoffs = spark.createDataFrame([(s, 15 + 2 * s) for s in SAMPLES], "sample bigint, min_q int")
    return C.allele_counts(C.sample_quality(pileup(spark, d), cutoffs))


@query(_COUNTS + ", a as (select chr, pos, sum(n_a) as n_a, sum(n_c) as n_c, sum(n_g) as n_g, sum(n_t) as n_t from c group by all) select chr, pos, n_a::bigint as n_a, n_c::bigint as n_c, n_g::bigint as n_g, n_t::bigint as n_t from a")
def counts_merged(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    return C.merge_counts([C.allele_counts(r.where(F.col("sample").isin(g)), ("chr", "pos")) for g in _GROUPS])


@query(_COUNTS + """, x as (select *, n_a + n_c + n_g + n_t as d from c), s as (select chr, pos, count(*) filter (d between 2 and 4) as keep, coalesce(sum(d) filter (d between 2 and 4), 0)::bigint as depth,
 coalesce(max((n_a > 0)::int + (n_c > 0)::int + (n_g > 0)::int + (n_t > 0)::int) filter (sample = 0), 0) as al from x group by all) select chr, pos, keep, depth from s where keep >= 3 and depth >= 8 and depth <= 20 and al <= 1""")
def filter_sites_alleles(spark: SparkSession, d: str) -> DataFrame:
    return C.site_filter(C.allele_counts(pileup(spark, d)), min_ind=3, min_depth_ind=2, max_depth_ind=4, min_depth=8, max_depth=20, max_alleles_first=1).select("chr", "pos", "keep", "depth")


_GATES = """, dp as (select r.chr, r.pos, r.sample, count(*) as depth, count(*) filter (base = major) as n_major, count(*) filter (base = minor) as n_minor from r join f on f.chr = r.chr and f.pos = r.pos group by all),
po as (select l.chr, l.pos, l.sample, l0 * (1 - freq) * (1 - freq) as a, l1 * 2 * freq * (1 - freq) as b, l2 * freq * freq as c from l join f using (chr, pos)),
gt as (select chr, pos, sample, case when greatest(a, b, c) / (a + b + c) <= 0.8 then -1 when a = greatest(a, b, c) then 0 when b = greatest(a, b, c) then 1 else 2 end as g from po),
ga as (select gt.chr, gt.pos, gt.sample, case when depth < 2 or depth > 8 or (g = 1 and least(n_major, n_minor) < 0.2 * depth) then -1 else g end::int as geno from gt join dp using (chr, pos, sample))
select chr, pos, sample, geno from ga where (chr, pos) in (select (chr, pos) from ga group by chr, pos having count(*) filter (geno >= 0) >= 5)"""


@query(_EM + _GATES)
def genotype_calls_gated(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    f = _freq(spark, d, True)
    post = L.posterior(M.long_likelihoods(f, "freq"))
    return L.gate_genotypes(L.call_genotypes(post, 0.8), C.allele_counts(r), f, min_depth=2, max_depth=8, min_share=0.2, min_ind=5).select("chr", "pos", "sample", "geno")


# errors and patterns


@query(CTE + """, n as (select sample, sum((anc <> base)::int) as x, sum((anc <> ref)::int) as p, sum((anc = ref)::int) as same from r where base between 0 and 3 group by sample)
select sample, round((x - p) / (same - p)::double, 6) + 0 as rate from n""")
def ancestral_overall_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.overall_error(_by_ancestor(spark, d)), "rate", digits=6)


def _by_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return C.ancestral_errors(pileup(spark, d)).where("chr is null")


@query()
def ancestral_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.ancestral_error_rates(_by_ancestor(spark, d)), "rate")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    pops = spark.createDataFrame([(s, s // 3) for s in SAMPLES], "sample bigint, pop int")
    return P.population_frequencies(C.allele_counts(pileup(spark, d)), pops)


_POPS = _COUNTS + """, w as (select chr, pos, sample // 3 as pop, n_a, n_c, n_g, n_t, (n_a + n_c + n_g + n_t)::double as d from c),
q as (select chr, pos, pop, [sum(2 * d / (d + 1) * n_a / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_c / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_g / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_t / d) / sum(2 * d / (d + 1))] as f from w group by all),
k as (select a.chr, (a.pos + 1) // 500 as block, a.f as x, b.f as y, c.f as z, o.f as o from q a join q b on b.chr = a.chr and b.pos = a.pos and b.pop = 1 join q c on c.chr = a.chr and c.pos = a.pos and c.pop = 2 join q o on o.chr = a.chr and o.pos = a.pos and o.pop = 3 where a.pop = 0),
i as (select unnest(range(256)) as k), t as (select chr, block, i.k as k, sum(x[i.k // 64 + 1] * y[i.k // 16 % 4 + 1] * z[i.k // 4 % 4 + 1] * o[i.k % 4 + 1]) as v from k, i group by all)"""


@query(_POPS + " select chr, block, k::int as pattern, round(v, 5) + 0 as n from t")
def abba_baba_patterns(spark: SparkSession, d: str) -> DataFrame:
    t = X.pattern_table(_frequencies(spark, d), [(0, 1, 2, 3)], 500)
    return rounded(t.select("chr", "block", F.posexplode("patterns").alias("pattern", "n")), "n")


@query(_POPS + f""", s as (select chr, block, sum(v) filter (k in {tuple(64 * a + 16 * b + 4 * c + e for a, b, c, e in X.ABBA)}) as a, sum(v) filter (k in {tuple(64 * a + 16 * b + 4 * c + e for a, b, c, e in X.BABA)}) as b from t group by all)
select round((sum(a) - sum(b)) / (sum(a) + sum(b)), 5) as d, count(*) as n_blocks from s""")
def abba_baba_corrected(spark: SparkSession, d: str) -> DataFrame:
    """With equal rates of all errors the corrected statistic's sums are the plain ones on a smaller scale; here without any errors."""
    t = X.pattern_sums(X.corrected_patterns(X.pattern_table(_frequencies(spark, d), [(0, 1, 2, 3)], 500), {p: np.eye(4) for p in range(4)}))
    j = P.jackknife(t, ["h1", "h2", "h3", "h4"], F.col("n_abba") - F.col("n_baba"), F.col("n_abba") + F.col("n_baba"))
    return rounded(j.select("d", "n_blocks"), "d")


@query(CTE + """, x as (select chr, pos, [coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = 0), 0), coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = 1), 0), coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = 2), 0), coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = 3), 0)] as e from r group by all)
select chr, pos, (list_position(e, list_max(e)) - 1)::int as base from x""")
def deepest_bases(spark: SparkSession, d: str) -> DataFrame:
    return C.deepest_base(pileup(spark, d))


# estimates with a fixed number of rounds

_MIX = "(r.e / 3 + x[r.b + 1] * (1 - 4 * r.e / 3))"


@query(CTE + f""", g as (select chr, pos, sample, list({{'b': base, 'e': pow(10.0, -qs / 10.0)}}) as rs, count(*)::int as depth from r where base between 0 and 3 group by all),
x as (select chr, pos, sample, depth, rs, list_reduce(range(20), lambda x, i: list_transform([0, 1, 2, 3], lambda k: (x[k + 1] + list_sum(list_transform(rs, lambda r: (case when r.b = k then 1 - r.e else r.e / 3 end) * x[k + 1] / {_MIX}))) / (1 + depth)), [0.25::double, 0.25, 0.25, 0.25]) as x from g)
select chr, pos, sample, depth, {", ".join(f"round(x[{k + 1}], 4) + 0 as f{k}" for k in range(4))}, round(greatest(0, 2 * (list_sum(list_transform(rs, lambda r: ln({_MIX}))) -
 list_max(list_transform([0, 1, 2, 3], lambda k: list_sum(list_transform(rs, lambda r: ln(case when r.b = k then 1 - r.e else r.e / 3 end))))))), 3) + 0 as lrt from x""")
def heteroplasmy(spark: SparkSession, d: str) -> DataFrame:
    h = M.heteroplasmy(pileup(spark, d), 20, 0.0)
    return rounded(rounded(h, "f0", "f1", "f2", "f3", digits=4), "lrt", digits=3)


def _frequency_sql(ls: str, rounds: int, start: float) -> str:
    return f"list_reduce(range({rounds}), lambda p, i: list_avg(list_transform({ls}, lambda x: (x.b * 2 * p * (1 - p) + 2 * x.c * p * p) / (2 * (x.a * (1 - p) * (1 - p) + x.b * 2 * p * (1 - p) + x.c * p * p)))), {start}::double)"


def _lik_sql(ls: str, p: str) -> str:
    return f"list_sum(list_transform({ls}, lambda x: ln(greatest(x.a * (1 - {p}) * (1 - {p}) + x.b * 2 * {p} * (1 - {p}) + x.c * {p} * {p}, 1e-300))))"


@query(_THREE + f""", h as (select chr, pos, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) as ls, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) filter (sample % 2 = 1) as s1, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) filter (sample % 2 = 0) as s0 from l group by all),
f as (select *, {_frequency_sql("ls", 25, 0.1)} as p, case when s1 is null then 0 else {_frequency_sql("s1", 25, 0.1)} end as p1, case when s0 is null then 0 else {_frequency_sql("s0", 25, 0.1)} end as p0 from h)
select chr, pos, round(p, 3) + 0 as freq, round(p1, 3) + 0 as freq_case, round(p0, 3) + 0 as freq_control, round(greatest(0, 2 * (coalesce({_lik_sql("s1", "p1")}, 0) + coalesce({_lik_sql("s0", "p0")}, 0) - {_lik_sql("ls", "p")})), 3) + 0 as lrt from f""")
def association_case_control(spark: SparkSession, d: str) -> DataFrame:
    t = A.case_control(_l3(spark, d), _pheno(spark).drop("y").withColumnRenamed("sex", "y"), 25, 0.0)
    return rounded(t.drop("p_value"), "freq", "freq_case", "freq_control", "lrt", digits=3)


_G10 = " + ".join(f"x[{i + 1}] * f[{a + 1}] * f[{b + 1}]{'' if a == b else ' * 2'}" for i, (a, b) in enumerate(GENOTYPES))
_COPIES = [" + ".join(f"x[{i + 1}] * f[{a + 1}] * f[{b + 1}]{'' if a == b else ' * 2'} * {((a == k) + (b == k)) / 2}" for i, (a, b) in enumerate(GENOTYPES) if k in (a, b)) for k in range(4)]


@query(_EM + f""", q as (select chr, pos, list(list_transform(g, lambda v: exp(v)) order by sample) as gs from g where list_max(g) - list_min(g) > 1e-9 group by all),
z as (select chr, pos, gs, list_reduce(range(15), lambda f, i: [{", ".join(f"list_avg(list_transform(gs, lambda x: ({c}) / ({_G10})))" for c in _COPIES)}], [0.25::double, 0.25, 0.25, 0.25]) as f from q)
select chr, pos, {", ".join(f"round(f[{k + 1}], 4) + 0 as f{k}" for k in range(4))}, round(list_sum(list_transform(gs, lambda x: ln({_G10}))), 3) + 0 as lik from z""")
def four_frequencies(spark: SparkSession, d: str) -> DataFrame:
    gl = _gl(spark, d)
    t = M.allele_models(M.collected_gl(gl, _alleles(gl)), 15, 0.0)
    return rounded(rounded(t.select("chr", "pos", "f0", "f1", "f2", "f3", "lik"), "f0", "f1", "f2", "f3", digits=4), "lik", digits=3)


# leave-one-out posteriors and spectra of blocks


def _weights(n: int) -> list[list[float]]:
    p = NEUTRAL / NEUTRAL.sum()
    return [[float(p[j + g]) * math.comb(2, g) * math.comb(2 * n - 2, j) / math.comb(2 * n, j + g) for j in range(2 * n - 1)] for g in range(3)]


@query(_THREE + f""", a as (select chr, pos, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) as ls, count(*) as m from l group by all),
b as (select chr, pos, list_concat(ls, list_transform(range(10 - m), lambda i: {{'a': 1.0::double, 'b': 1.0::double, 'c': 1.0::double}})) as ls from a),
k as (select chr, pos, ls, unnest(range(10)) as k from b),
o as (select chr, pos, k, ls[k + 1] as own, {_steps("list_concat(ls[1:k], ls[k + 2:])", 9)} as s from k),
w as (select chr, pos, k, {", ".join(f"own.{c} * list_inner_product(list_transform(s, lambda v: exp(v - list_max(s))), {w!r}) as w{g}" for g, (c, w) in enumerate(zip("abc", _weights(10))))} from o)
select chr, pos, k::int as k, round(w0 / (w0 + w1 + w2), 4) + 0 as p0, round(w1 / (w0 + w1 + w2), 4) + 0 as p1, round(w2 / (w0 + w1 + w2), 4) + 0 as p2 from w""")
def posterior_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.spectrum_posterior(_sites(spark, d), NEUTRAL, 10), "p0", "p1", "p2", digits=4)


@query(_THREE + _saf_sql("sf", SAMPLES) + """, n as (select chr, (row_number() over (partition by chr order by pos) - 1) // 100 as block, list_transform(s, lambda v: exp(v)) as s from sf),
bl as (select chr, block, list(s) as s, count(*) as n_sites from n group by all),
x as (select chr, block, n_sites, list_reduce(range(50), lambda x, i: list_transform(range(21), lambda k: list_avg(list_transform(s, lambda v: v[k + 1] * x[k + 1] / list_inner_product(v, x)))), list_transform(range(21), lambda k: 1 / 21.0::double)) as x from bl)
select chr, block::bigint as block, n_sites, unnest(range(21))::int as bin, round(unnest(x) * n_sites, 3) + 0 as value from x""")
def block_spectra(spark: SparkSession, d: str) -> DataFrame:
    b = S.block_spectra(_saf(spark, d, SAMPLES), 100, 21)
    return b.select("chr", "block", "n_sites", F.posexplode("sfs").alias("bin", "value")).withColumn("value", F.round("value", 3) + F.lit(0.0))
