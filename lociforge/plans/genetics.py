"""Queries of likelihoods, estimators, spectra, sample comparisons and association, over the pileup view and the project's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.genotypes import GENOTYPES, PAIRS, genotype, harmonic
from lociforge.operators import association as A
from lociforge.operators import counting as C
from lociforge.operators import estimators as E
from lociforge.operators import likelihood as L
from lociforge.operators import models as M
from lociforge.operators import pairs as P
from lociforge.operators import spectrum as S
from lociforge.plans.counting import _COUNTS, _SAMPLED
from lociforge.plans.pileup import CTE, SAMPLES, pileup
from lociforge.session import table

QUERIES, SQL = {}, {}
#: A made-up matrix of base error rates, a spectrum of 20 chromosomes that falls as 1/i, and the rounds of compared EMs.
ERRORS = [[0.97, 0.01, 0.012, 0.008], [0.01, 0.97, 0.008, 0.012], [0.012, 0.008, 0.97, 0.01], [0.008, 0.012, 0.01, 0.97]]
NEUTRAL = np.array([90.0, *(1 / i for i in range(1, 20)), 2.0])
ROUNDS = 20


def query(sql: str | None = None):
    """Registers a function (spark, directory) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 5) -> DataFrame:
    """Columns rounded, with -0 as 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# SQL of the shared steps: likelihoods g (list of ten) by chr, pos, sample; pair scores; alleles mm; likelihoods l0, l1, l2
_HOM, _HET, _OFF = "ln(1 - pow(10.0, -qs / 10.0))", "ln(0.5 * (1 - pow(10.0, -qs / 10.0)) + pow(10.0, -qs / 10.0) / 6)", "ln(pow(10.0, -qs / 10.0) / 3)"
_GENO = ", ".join(f"sum(case when base = {a} {'' if a == b else f'or base = {b}'} then {_HOM if a == b else _HET} else {_OFF} end)" for a, b in GENOTYPES)
_GL = f"{CTE}, g0 as (select chr, pos, sample, [{_GENO}] as g from r group by all), g as (select chr, pos, sample, list_transform(g, lambda x: x - list_max(g)) as g from g0)"
_LSE = "({a} + ln(1 + exp({b} - {a}) + exp({c} - {a})))"


def _score(a: int, b: int) -> str:
    x, y, z = f"g[{genotype(a, a) + 1}]", f"(g[{genotype(a, b) + 1}] + 0.6931471805599453)", f"g[{genotype(b, b) + 1}]"
    return f"sum(greatest({x}, {y}, {z}) + ln(exp({x} - greatest({x}, {y}, {z})) + exp({y} - greatest({x}, {y}, {z})) + exp({z} - greatest({x}, {y}, {z}))) - 1.3862943611198906)"


def _expected(a: int, b: int) -> str:
    x, y, z = f"g[{genotype(a, a) + 1}]", f"(g[{genotype(a, b) + 1}] + 0.6931471805599453)", f"g[{genotype(b, b) + 1}]"
    top = f"greatest({x}, {y}, {z})"
    return f"avg((exp({y} - {top}) + 2 * exp({z} - {top})) / (2 * (exp({x} - {top}) + exp({y} - {top}) + exp({z} - {top}))))"


_SCORES = _GL + ", sc as (select chr, pos, count(*) as keep, [" + ", ".join(_score(a, b) for a, b in PAIRS) + "] as s, [" + ", ".join(_expected(a, b) for a, b in PAIRS) + "] as e from g where list_max(g) - list_min(g) > 1e-9 group by all)"
_FIRST, _SECOND = [a for a, _ in PAIRS], [b for _, b in PAIRS]
_BEST = _SCORES + f""", mm as (select chr, pos, keep, case when round(e[k], 9) < 0.5 then {_FIRST}[k] else {_SECOND}[k] end as major, case when round(e[k], 9) < 0.5 then {_SECOND}[k] else {_FIRST}[k] end as minor
  from (select *, list_position(list_transform(s, lambda x: round(x, 9)), round(list_max(s), 9)) as k from sc))"""
_LUT = [[genotype(a, b) + 1 for b in range(4)] for a in range(4)]
_THREE = _BEST + f""", t0 as (select g.chr, g.pos, sample, major, minor, g[{_LUT}[major + 1][major + 1]] as a, g[{_LUT}[major + 1][minor + 1]] as b, g[{_LUT}[minor + 1][minor + 1]] as c from g join mm using (chr, pos)),
l as (select chr, pos, sample, major, minor, exp(a - greatest(a, b, c)) as l0, exp(b - greatest(a, b, c)) as l1, exp(c - greatest(a, b, c)) as l2 from t0 where greatest(a, b, c) - least(a, b, c) > 1e-9)"""
_EM = _THREE + f""", ls as (select chr, pos, major, minor, list({{'a': l0, 'b': l1, 'c': l2}} order by sample) as ls from l group by all),
f as (select chr, pos, major, minor, ls, list_reduce(range({ROUNDS}), lambda p, i: list_avg(list_transform(ls, lambda x: (x.b * 2 * p * (1 - p) + 2 * x.c * p * p) / (2 * (x.a * (1 - p) * (1 - p) + x.b * 2 * p * (1 - p) + x.c * p * p)))), 0.001::double) as freq from ls)"""


def _alleles(gl: DataFrame) -> DataFrame:
    return L.best_pair(L.pair_scores(gl))


def _gl(spark: SparkSession, d: str) -> DataFrame:
    return L.gl_gatk(pileup(spark, d))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return M.likelihood_sites(_gl(spark, d))


def _l3(spark: SparkSession, d: str) -> DataFrame:
    return M.long_likelihoods(_sites(spark, d))


def _freq(spark: SparkSession, d: str, keep_samples: bool = False) -> DataFrame:
    return E.frequencies(_sites(spark, d), ROUNDS, 0.0, keep_samples)


@query(_GL + "select chr, pos, sample, " + ", ".join(f"round(g[{i + 1}], 5) + 0 as g{i}" for i in range(10)) + " from g")
def gl_gatk(spark: SparkSession, d: str) -> DataFrame:
    g = _gl(spark, d)
    return rounded(g.select("chr", "pos", "sample", *(F.element_at("gl", i + 1).alias(f"g{i}") for i in range(10))), *(f"g{i}" for i in range(10)))


_SYK = ", ".join("(" + " + ".join(f"{n} * ln({(ERRORS[a][i] + ERRORS[b][i]) / 2!r})" for i, n in enumerate(C.N4)) + ")" for a, b in GENOTYPES)


@query(_COUNTS + f", g0 as (select chr, pos, sample, [{_SYK}] as g from c) select chr, pos, sample, " + ", ".join(f"round(g[{i + 1}] - list_max(g), 5) + 0 as g{i}" for i in range(10)) + " from g0")
def gl_error_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = L.gl_errors(C.allele_counts(pileup(spark, d)), ERRORS)
    return rounded(g.select("chr", "pos", "sample", *(F.element_at("gl", i + 1).alias(f"g{i}") for i in range(10))), *(f"g{i}" for i in range(10)))


@query(_COUNTS + _SAMPLED + "select chr, pos, sample, " + ", ".join(f"case when base = {a} and base = {b} then 0 when base = {a} or base = {b} then round(ln(0.5), 5) else -1e30 end::double as g{i}" for i, (a, b) in enumerate(GENOTYPES)) + " from hb")
def gl_sampled_base(spark: SparkSession, d: str) -> DataFrame:
    g = L.gl_sampled(C.sampled_base(pileup(spark, d)))
    return rounded(g.select("chr", "pos", "sample", *(F.element_at("gl", i + 1).alias(f"g{i}") for i in range(10))), *(f"g{i}" for i in range(10)))


@query(_BEST + "select chr, pos, keep, major, minor from mm")
def major_minor_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return _alleles(_gl(spark, d))


@query(_SCORES + f""", rf as (select chr, pos, max(ref) as major from r group by all),
j as (select chr, pos, keep, major, list_transform(s, lambda x, i: case when [{', '.join(f'major in ({a}, {b})' for a, b in PAIRS)}][i] then round(x, 9) end) as s from sc join rf using (chr, pos))
select chr, pos, keep, major, {[a + b for a, b in PAIRS]}[list_position(s, list_max(s))] - major as minor from j""")
def major_fixed_reference(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    return L.best_minor(L.pair_scores(L.gl_gatk(r)), r.groupBy("chr", "pos").agg(F.max("ref").alias("major")))


@query(_EM + """select chr, pos, major, minor, len(ls)::int as n, round(freq, 4) + 0 as freq, round(greatest(0, 2 * (
list_sum(list_transform(ls, lambda x: ln(x.a * (1 - freq) * (1 - freq) + x.b * 2 * freq * (1 - freq) + x.c * freq * freq))) - list_sum(list_transform(ls, lambda x: ln(greatest(x.a, 1e-300)))))), 3) + 0 as lrt from f""")
def maf_em(spark: SparkSession, d: str) -> DataFrame:
    f = _freq(spark, d)
    return rounded(rounded(f.select("chr", "pos", "major", "minor", "n", "freq", "lrt"), "freq", digits=4), "lrt", digits=3)


@query(_EM + f"""select chr, pos, major, minor, round(freq, 4) as freq from f where greatest(0, 2 * (
list_sum(list_transform(ls, lambda x: ln(x.a * (1 - freq) * (1 - freq) + x.b * 2 * freq * (1 - freq) + x.c * freq * freq))) - list_sum(list_transform(ls, lambda x: ln(greatest(x.a, 1e-300)))))) >= {E.chi2_threshold(1e-6)!r} and abs(major - minor) <> 2 and freq between 0.05 and 0.95""")
def filter_snps(spark: SparkSession, d: str) -> DataFrame:
    f = L.drop_transitions(_freq(spark, d))
    f = f.where((F.col("lrt") >= E.chi2_threshold(1e-6)) & F.col("freq").between(0.05, 0.95))
    return rounded(f.select("chr", "pos", "major", "minor", "freq"), "freq", digits=4)


_POST = _EM + """, po as (select l.chr, l.pos, l.sample, l.major, l.minor, l0 * (1 - freq) * (1 - freq) as a, l1 * 2 * freq * (1 - freq) as b, l2 * freq * freq as c from l join f using (chr, pos)),
post as (select chr, pos, sample, major, minor, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2 from po)"""


def _post(spark: SparkSession, d: str) -> DataFrame:
    return L.posterior(M.long_likelihoods(_freq(spark, d, True), "freq"))


@query(_POST + "select chr, pos, sample, major, minor, round(p0, 4) + 0 as p0, round(p1, 4) + 0 as p1, round(p2, 4) + 0 as p2 from post")
def posterior_hwe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_post(spark, d).drop("freq"), "p0", "p1", "p2", digits=4)


@query(_THREE + "select chr, pos, sample, major, minor, round(l0 / (l0 + l1 + l2), 5) as p0, round(l1 / (l0 + l1 + l2), 5) as p1, round(l2 / (l0 + l1 + l2), 5) as p2 from l")
def posterior_uniform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.posterior(_l3(spark, d)), "p0", "p1", "p2")


@query(_POST + "select chr, pos, sample, (case when greatest(p0, p1, p2) <= 0.9 then -1 when p0 = greatest(p0, p1, p2) then 0 when p1 = greatest(p0, p1, p2) then 1 else 2 end)::int as geno from post")
def genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    return L.call_genotypes(_post(spark, d), 0.9).select("chr", "pos", "sample", "geno")


@query("""with u as (select distinct on (rec_id) rec_id, panel_id, marker, allele1, allele2, nind, genos from beagle_genos where genos is not null and len(genos) = 3 * nind),
e as (select rec_id, marker, unnest(range(nind)) as i, genos from u),
t as (select rec_id, marker, genos[3 * i + 1] as a, genos[3 * i + 2] as b, genos[3 * i + 3] as c from e)
select rec_id, regexp_extract(marker, '^(.*)_([0-9]+)$', 1) as contig, regexp_extract(marker, '^(.*)_([0-9]+)$', 2)::bigint as pos, round(avg(case when a + b + c > 0 then (b + 2 * c) / (2 * (a + b + c)) end), 6) as ppmaf,
count(*) filter (a + b + c > 0) as n_ind from t group by rec_id, marker""")
def beagle_frequencies(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "beagle_genos").where("genos is not null and size(genos) = 3 * nind").dropDuplicates(["rec_id"])
    # positions of the triples, summed inside the row: nothing is exploded or shuffled but for the repeats
    ind = F.sequence(F.lit(0), F.col("nind") - 1)
    total = lambda i: F.element_at("genos", 3 * i + 1) + F.element_at("genos", 3 * i + 2) + F.element_at("genos", 3 * i + 3)
    good = F.filter(ind, lambda i: total(i) > 0)
    dose = F.reduce(F.transform("good", lambda i: (F.element_at("genos", 3 * i + 2) + 2 * F.element_at("genos", 3 * i + 3)) / (2 * total(i))), F.lit(0.0), lambda a, x: a + x)
    g = g.where("nind > 0").withColumn("good", good)
    return g.select("rec_id", F.regexp_extract("marker", "^(.*)_([0-9]+)$", 1).alias("contig"), F.regexp_extract("marker", "^(.*)_([0-9]+)$", 2).cast("bigint").alias("pos"),
                    F.round(dose / F.nullif(F.size("good"), F.lit(0)), 6).alias("ppmaf"), F.size("good").cast("bigint").alias("n_ind"))


# spectra, diversity, fixation


def _saf(spark: SparkSession, d: str, samples: list[int]) -> DataFrame:
    sites = L.collected(_l3(spark, d).where(F.col("sample").isin(samples)))
    return E.allele_frequency_likelihoods(sites, len(samples))


@query()
def sfs_em(spark: SparkSession, d: str) -> DataFrame:
    sfs = S.estimate_spectrum([_saf(spark, d, SAMPLES)], (21,))
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(sfs)], "bin int, value double")


@query()
def sfs_em_two_populations(spark: SparkSession, d: str) -> DataFrame:
    sfs = S.estimate_spectrum([_saf(spark, d, SAMPLES[:4]), _saf(spark, d, SAMPLES[4:])], (9, 13))
    return spark.createDataFrame([(*c, round(float(x), 4)) for c, x in zip(S.spectrum_bins((9, 13)), sfs)], "c1 int, c2 int, value double")


@query()
def fst_two_populations(spark: SparkSession, d: str) -> DataFrame:
    one, two = _saf(spark, d, SAMPLES[:4]), _saf(spark, d, SAMPLES[4:])
    sfs = S.estimate_spectrum([one, two], (9, 13))
    return rounded(S.fst_windows(S.fst_sites(one, two, sfs, 8, 12), 500, 100), "fst_unweighted", "fst_weighted")


_A1 = harmonic(20)
_WIN = """with u as (select distinct block_id, posi, exp(tw) as tw, exp(tp) as tp, exp(tf) as tf, exp(th) as th, exp(tl) as tl from theta_sites where posi is not null),
e as (select block_id, (min(posi) // 1000) * 1000 + 1000 as o, max(posi) as z from u group by block_id),
w as (select block_id, z, unnest(range(o, z - 5000 + 1, 1000)) as s from e),
x as (select w.block_id, s, s + 5000 as t, coalesce(sum(tw), 0) as tw, coalesce(sum(tp), 0) as tp, coalesce(sum(tf), 0) as tf, coalesce(sum(th), 0) as th, coalesce(sum(tl), 0) as tl, count(*) as n from w join u on u.block_id = w.block_id and posi >= s and posi < s + 5000 group by w.block_id, s)"""


def _thetas(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "theta_sites").where("posi is not null").select("block_id", F.col("posi").cast("bigint").alias("posi"), *(F.exp(c).alias(c) for c in ("tw", "tp", "tf", "th", "tl")))
    return t.distinct()


def _tajima_sql() -> str:
    n, a1, a2 = 20, _A1, sum(1 / i**2 for i in range(1, 20))
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    s = f"(tw * {a1!r})"
    var = f"({c1 / a1!r} * {s} + {c2 / (a1 * a1 + a2)!r} * {s} * ({s} - 1))"
    return f"case when {s} = 0 then 0 when {var} > 0 then round((tp - tw) / sqrt({var}), 4) end"


@query(_WIN + f" select block_id, s as win_start, t as win_stop, n as n_sites, round(tw, 5) as tw, round(tp, 5) as tp, round(tf, 5) as tf, round(th, 5) as th, round(tl, 5) as tl, {_tajima_sql()} + 0 as tajima from x")
def theta_windows(spark: SparkSession, d: str) -> DataFrame:
    w = S.window_thetas(_thetas(spark, d), 20, 5000, 1000, "block_id", "posi")
    w = rounded(rounded(w, "tw", "tp", "tf", "th", "tl"), "tajima", digits=4)
    return w.select("block_id", F.col("win_start").cast("bigint"), F.col("win_stop").cast("bigint"), "n_sites", "tw", "tp", "tf", "th", "tl", "tajima")


@query("""with u as (select distinct block_id, posi, exp(tw) as tw, exp(tp) as tp, exp(tf) as tf, exp(th) as th, exp(tl) as tl from theta_sites where posi is not null),
z as (select *, max(posi) over (partition by block_id) as z from u), x as (select block_id, sum(tw) as tw, coalesce(sum(tp), 0) as tp, count(*) as n_sites from z where posi < z group by block_id)
select block_id, n_sites, round(tw, 5) as tw, round(tp, 5) as tp, """ + _tajima_sql() + " + 0 as tajima from x")
def theta_totals(spark: SparkSession, d: str) -> DataFrame:
    w = rounded(rounded(S.total_thetas(_thetas(spark, d), 20, "block_id", "posi"), "tw", "tp"), "tajima", digits=4)
    return w.select("block_id", "n_sites", "tw", "tp", "tajima")


# comparisons of samples


@query(_COUNTS + _SAMPLED + """select a.sample::int as i, b.sample::int as j, count(*) as n_both, count(*) filter (a.base <> b.base) as n_diff, round(count(*) filter (a.base <> b.base) / count(*), 6) as ibs
from hb a join hb b on a.chr = b.chr and a.pos = b.pos and a.sample < b.sample group by a.sample, b.sample""")
def ibs_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.ibs_matrix(C.sampled_base(pileup(spark, d)), 10), "ibs", digits=6)


@query(_COUNTS + _SAMPLED + """, al as (select chr, pos, max(ref) as major, (max(ref) + 1) % 4 as minor from r group by chr, pos),
h2 as (select chr, pos, sample, (base = minor)::int as g from hb join al using (chr, pos) where base in (major, minor)),
fr as (select chr, pos, avg(g) as f from h2 group by all having avg(g) between 0.001 and 0.999),
st as (select chr, pos, sample, (g - f) / sqrt(f * (1 - f)) as z from h2 join fr using (chr, pos))
select a.sample::int as i, b.sample::int as j, round(sum(a.z * b.z) / count(*), 5) + 0 as cov, count(*) as n_sites from st a join st b on a.chr = b.chr and a.pos = b.pos and a.sample <= b.sample group by a.sample, b.sample""")
def covariance_sampled(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    alleles = r.groupBy("chr", "pos").agg(F.max("ref").alias("major")).withColumn("minor", ((F.col("major") + 1) % 4).cast("int"))
    return rounded(P.sampled_covariance(C.sampled_base(r), alleles, 10), "cov")


@query(_POST + """, e as (select post.chr, post.pos, sample, p1 + 2 * p2 as e, freq, greatest(p0, p1, p2) >= 0.95 as sure from post join f on f.chr = post.chr and f.pos = post.pos where freq between 0.2 and 0.8),
a as (select chr, pos, (sum(e) + (10 - count(*)) * 2 * any_value(freq)) / 10 as a, count(*) filter (sure) as k from e group by all),
k as (select e.chr, e.pos, sample, (e - a) / sqrt(freq * (1 - freq)) as z from e join a on a.chr = e.chr and a.pos = e.pos where sure and k >= 5)
select a.sample::int as i, b.sample::int as j, round(sum(a.z * b.z) / count(*), 4) + 0 as cov, count(*) as n_sites from k a join k b on a.chr = b.chr and a.pos = b.pos and a.sample <= b.sample group by a.sample, b.sample""")
def covariance_posterior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.posterior_covariance(_post(spark, d), 10), "cov", digits=4)


_ABBA = _COUNTS + _SAMPLED + """, an as (select chr, pos, max(anc) as anc from r group by all),
k as (select a.chr, (a.pos + 1) // 200 as block, a.sample as h1, b.sample as h2, c.sample as h3, a.base as x, b.base as y, c.base as z, anc
  from hb a join hb b on a.chr = b.chr and a.pos = b.pos and a.sample < b.sample join hb c on c.chr = a.chr and c.pos = a.pos and c.sample <> a.sample and c.sample <> b.sample join an on an.chr = a.chr and an.pos = a.pos),
ab as (select chr, block, h1::int as h1, h2::int as h2, h3::int as h3, count(*) filter (y = z and x = anc and z <> anc) as n_abba, count(*) filter (x = z and y = anc and z <> anc) as n_baba from k group by all)
"""


def _dstat(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    return P.abba_baba(C.sampled_base(r), r.groupBy("chr", "pos").agg(F.max("anc").alias("anc")), 10, block=200)


@query(_ABBA + "select * from ab")
def abba_baba(spark: SparkSession, d: str) -> DataFrame:
    return _dstat(spark, d)


@query(_ABBA + """, t as (select h1, h2, h3, (n_abba - n_baba)::double as a, (n_abba + n_baba)::double as b, sum(n_abba - n_baba) over w as ta, sum(n_abba + n_baba) over w as tb, count(*) over w as k from ab window w as (partition by h1, h2, h3)),
j as (select h1, h2, h3, any_value(ta / tb) as d, sqrt(var_pop((ta - a) / (tb - b)) * (any_value(k) - 1)) as se, any_value(k) as n_blocks from t group by all)
select h1, h2, h3, round(d, 6) + 0 as d, round(se, 5) as se, n_blocks from j""")
def abba_baba_jackknife(spark: SparkSession, d: str) -> DataFrame:
    j = P.jackknife(_dstat(spark, d), ["h1", "h2", "h3"], F.col("n_abba") - F.col("n_baba"), F.col("n_abba") + F.col("n_baba"))
    return rounded(rounded(j, "d", digits=6), "se").select("h1", "h2", "h3", "d", "se", "n_blocks")


@query(_COUNTS + """, w as (select chr, pos, sample // 3 as pop, n_a, n_c, n_g, n_t, (n_a + n_c + n_g + n_t)::double as d from c where sample < 9 or sample = 9),
q as (select chr, pos, pop, [sum(2 * d / (d + 1) * n_a / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_c / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_g / d) / sum(2 * d / (d + 1)), sum(2 * d / (d + 1) * n_t / d) / sum(2 * d / (d + 1))] as f from w group by all),
k as (select a.chr, (a.pos + 1) // 500 as block, a.f as x, b.f as y, c.f as z, o.f as o from q a join q b on b.chr = a.chr and b.pos = a.pos and b.pop = 1 join q c on c.chr = a.chr and c.pos = a.pos and c.pop = 2 join q o on o.chr = a.chr and o.pos = a.pos and o.pop = 3 where a.pop = 0),
m as (select chr, block, list_sum(list_transform([0,1,2,3], lambda i: list_sum(list_transform([0,1,2,3], lambda j: case when i = j then 0 else x[i+1] * y[j+1] * z[j+1] * o[i+1] end)))) as abba,
 list_sum(list_transform([0,1,2,3], lambda i: list_sum(list_transform([0,1,2,3], lambda j: case when i = j then 0 else x[j+1] * y[i+1] * z[j+1] * o[i+1] end)))) as baba from k)
select chr, block, 0 as h1, 1 as h2, 2 as h3, 3 as h4, round(sum(abba - baba), 5) + 0 as numer, round(sum(abba + baba), 5) + 0 as denom, count(*) as n_sites from m group by chr, block""")
def abba_baba_populations(spark: SparkSession, d: str) -> DataFrame:
    pops = spark.createDataFrame([(s, s // 3) for s in SAMPLES], "sample bigint, pop int")
    f = P.population_frequencies(C.allele_counts(pileup(spark, d)), pops)
    return rounded(P.abba_baba_populations(f, [(0, 1, 2, 3)], 500), "numer", "denom")


# association


def _pheno(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, float((s * 7) % 5), float(s % 2), float(s % 3)) for s in SAMPLES], "sample bigint, y double, sex double, cov1 double")


_SCORE = _POST + """, ph as (select l_suppkey % 10 as sample, any_value(((l_suppkey % 10) * 7 % 5)::double) as y from lineitem group by 1), x as (select chr, pos, p1 + 2 * p2 as e, p1 + 4 * p2 as q, y, avg(y) over (partition by chr, pos) as m from post join ph using (sample)),
s as (select chr, pos, count(*) as n, sum(e) as se, sum(q) as sq, sum(e * (y - m)) as u, sum((y - m) * (y - m) * (e * e - q)) as r, sum((y - m) * (y - m)) / (count(*) - 1) as v, sum(y * y + 2 * y * m) as t from x group by all having count(*) > 1 and max(y) > min(y)),
i as (select chr, pos, n, se / (2 * n) as freq, u, v, sq / v + r / (v * v) - se * se / (n * v) - (u / (v * v)) * (u / (v * v)) / (t / (v * v * v) - n / (4 * pi() * v * v)) as i from s)
select chr, pos, n, round(freq, 3) + 0 as freq, case when abs(i) > 0.05 and freq between 0.02 and 0.98 then round((u / v) * (u / v) / i, 2) + 0 end as lrt from i"""


@query(_SCORE)
def association_score(spark: SparkSession, d: str) -> DataFrame:
    """All positions; the statistic of those that vary too little hangs on the last digits and stays null."""
    t = A.score_test(_post(spark, d), _pheno(spark), info=True)
    t = t.withColumn("lrt", F.when((F.abs("info") > 0.05) & F.col("freq").between(0.02, 0.98), F.round("lrt", 2) + F.lit(0.0)))
    return rounded(t.select("chr", "pos", "n", "freq", "lrt"), "freq", digits=3)


@query()
def association_score_covariates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.score_test(_post(spark, d), _pheno(spark), covariates=("cov1",)), "freq", "lrt", digits=3)


@query(_POST + """, ph as (select l_suppkey % 10 as sample, any_value(((l_suppkey % 10) * 7 % 5)::double) as y from lineitem group by 1), x as (select chr, pos, p1 + 2 * p2 as e, y from post join ph using (sample)),
s as (select chr, pos, count(*)::int as n, regr_slope(y, e) as beta, regr_syy(y, e) as syy, regr_sxx(y, e) as sxx, regr_sxy(y, e) as sxy from x group by all having count(*) > 3 and max(y) > min(y))
select chr, pos, n, round(beta, 2) + 0 as beta from s where sxx > 0.05""")
def association_dosage(spark: SparkSession, d: str) -> DataFrame:
    r = A.regress(_post(spark, d), _pheno(spark)).where("lrt is not null and n > 3 and sxx > 0.05")
    return rounded(r.select("chr", "pos", "n", "beta"), "beta", digits=2)


@query()
def association_latent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.regress(_post(spark, d), _pheno(spark), "latent", covariates=("cov1",)).drop("sxx"), "lrt", "beta", "se", digits=3)


@query()
def association_hybrid_binary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.regress(_post(spark, d), _pheno(spark).drop("y").withColumnRenamed("sex", "y"), "hybrid", "logistic").drop("sxx"), "lrt", "beta", "se", digits=3)
