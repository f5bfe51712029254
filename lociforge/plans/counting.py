"""Queries of the counting family and of the read and site filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators import counting as C
from lociforge.operators import reads as R
from lociforge.plans.pileup import CTE, SAMPLES, pileup
from lociforge.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, directory) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def big(df: DataFrame, *cols: str) -> DataFrame:
    """Counts as 64-bit numbers."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


_N = ", ".join(f"count(*) filter (base = {b}) as {C.N4[b]}" for b in range(4))
_COUNTS = f"{CTE}, c as (select chr, pos, sample, {_N} from r group by all)"
_TOTALS = f"{CTE}, c as (select chr, pos, {_N} from r group by all)"
#: Major is the first of the largest counts, minor the last of the largest others.
_MM = """, m as (select *, case when n_a >= n_c and n_a >= n_g and n_a >= n_t then 0 when n_c >= n_g and n_c >= n_t then 1 when n_g >= n_t then 2 else 3 end as major from c),
mm as (select *, list_max([{'n': case when major = 0 then -1 else n_a end, 'k': 0}, {'n': case when major = 1 then -1 else n_c end, 'k': 1},
  {'n': case when major = 2 then -1 else n_g end, 'k': 2}, {'n': case when major = 3 then -1 else n_t end, 'k': 3}]).k as minor from m)
"""


@query(_COUNTS + "select * from c")
def counts_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.allele_counts(pileup(spark, d))


@query(f"{CTE} select chr, pos, count(*) as depth from r group by all")
def counts_site_depth(spark: SparkSession, d: str) -> DataFrame:
    return C.site_depth(pileup(spark, d))


@query(f"{CTE} select chr, pos, {', '.join(f'count(*) filter (sample = {s}) as ind{s}' for s in SAMPLES)} from r group by all")
def counts_depth_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.depth_by_sample(pileup(spark, d), SAMPLES)


@query(_TOTALS + "select * from c")
def counts_base_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.allele_counts(pileup(spark, d), ("chr", "pos"))


@query(f"{CTE} select chr, pos, {', '.join(f'count(*) filter (sample = {s} and base = {b}) as ind{s}_{"acgt"[b]}' for s in SAMPLES for b in range(4))} from r group by all")
def counts_matrix(spark: SparkSession, d: str) -> DataFrame:
    return C.counts_matrix(pileup(spark, d), SAMPLES)


@query(f"{CTE} select chr, pos, round(avg(posi + isop + 1), 6) as mean_length, count(*) as n_reads from r group by all")
def counts_read_length(spark: SparkSession, d: str) -> DataFrame:
    return C.read_lengths(pileup(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


@query(f"{CTE} select chr, pos, {', '.join(f'coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = {b}), 0)::bigint as ebd_{"acgt"[b]}' for b in range(4))} from r group by all")
def counts_effective_depth(spark: SparkSession, d: str) -> DataFrame:
    return C.effective_depth(pileup(spark, d))


@query(f"{CTE}, q as (select qs, count(*) as n from r where qs >= 20 group by qs) select g::int as qs, coalesce(n, 0) as n from (select unnest(range(min(qs), max(qs) + 1)) as g from q) left join q on qs = g")
def counts_quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.quality_histogram(pileup(spark, d), 20)


@query(f"{CTE}, s as (select sample, least(count(*), 5) as depth from r group by chr, pos, sample) select sample, depth, count(*) as n_sites from s group by all")
def counts_depth_histogram_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.depth_histogram(pileup(spark, d), 5)


@query(f"{CTE}, s as (select least(count(*), 40) as depth from r group by chr, pos) select depth, count(*) as n_sites from s group by all")
def counts_depth_histogram_global(spark: SparkSession, d: str) -> DataFrame:
    return C.depth_histogram(pileup(spark, d), 40, per_sample=False)


@query(f"{CTE} select chr, pos, sample, " + ", ".join(f"count(*) filter (base = {b} and {'' if rev else 'not '}is_rev) as {'rev' if rev else 'fwd'}_{'acgtn'[b]}" for rev in (False, True) for b in range(5)) + " from r group by all")
def counts_strand(spark: SparkSession, d: str) -> DataFrame:
    return C.strand_counts(pileup(spark, d))


@query(f"{CTE} select posi, isop, qs, is_rev, ref, base, count(*) as n from r group by all")
def counts_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return C.mismatch_matrix(pileup(spark, d))


@query(f"{CTE} select sample, chr, anc, ref, base, count(*) as n from r group by grouping sets ((sample, anc, ref, base), (sample, chr, anc, ref, base))")
def counts_ancestral_errors(spark: SparkSession, d: str) -> DataFrame:
    return C.ancestral_errors(pileup(spark, d))


@query(f"{CTE}, f as (select chr, pos, sample, min_by(base, ord) as base, min_by(ref, ord) as ref, min_by(anc, ord) as anc from r group by all) select sample, chr, anc, ref, base, count(*) as n from f group by grouping sets ((sample, anc, ref, base), (sample, chr, anc, ref, base))")
def counts_ancestral_errors_first(spark: SparkSession, d: str) -> DataFrame:
    return C.ancestral_errors(pileup(spark, d), "first")


@query(
    CTE + ", s as (select 'length' as stat, (posi + isop + 1)::bigint as value from r union all select 'qs', qs from r union all select 'mapq', mapq from r"
    " union all select 'strand', is_rev::bigint from r union all select 'mismatch_qs', qs from r where base <> ref) select stat, value, count(*) as n from s group by all"
)
def counts_quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.quality_profile(pileup(spark, d))


@query(_COUNTS + "select chr, pos, sample, " + ", ".join(f"least({c}, 255) as {c}" for c in C.N4) + " from c")
def counts_smart(spark: SparkSession, d: str) -> DataFrame:
    return big(C.smart_counts(C.allele_counts(pileup(spark, d))), *C.N4)


@query(_COUNTS + "select c.* from c join (select distinct p_partkey from part where p_size < 20) on p_partkey = pos where greatest(n_a, n_c, n_g, n_t) <= 3")
def counts_at_sites(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "part").where("p_size < 20").selectExpr("p_partkey % 5 as chr", "p_partkey as pos")
    return C.counts_at(C.allele_counts(pileup(spark, d)), sites)


@query(_TOTALS + _MM + "select chr, pos, n_a, n_c, n_g, n_t, major, minor from mm")
def major_minor_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.major_minor(C.allele_counts(pileup(spark, d), ("chr", "pos")))


@query(_TOTALS.replace("select chr, pos,", "select chr, pos, max(ref) as ref,").replace("group by all)", "group by chr, pos)") + _MM.replace("case when n_a >= n_c and n_a >= n_g and n_a >= n_t then 0 when n_c >= n_g and n_c >= n_t then 1 when n_g >= n_t then 2 else 3 end as major", "ref as major") + "select chr, pos, major, minor from mm")
def major_reference(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    totals = r.groupBy("chr", "pos").agg(*(F.count_if(F.col("base") == b).alias(C.N4[b]) for b in range(4)), F.max("ref").alias("ref"))
    return C.major_minor(totals, major="ref").select("chr", "pos", "major", "minor")


@query(CTE + ", c as (select chr, pos, " + ", ".join(f"coalesce(sum(greatest(4, least(63, qs, mapq))) filter (base = {b}), 0)::bigint as {C.N4[b]}" for b in range(4)) + " from r group by all)" + _MM + "select chr, pos, major, minor from mm")
def major_minor_effective_depth(spark: SparkSession, d: str) -> DataFrame:
    return C.major_minor(C.effective_depth(pileup(spark, d)), [f"ebd_{x}" for x in "acgt"]).select("chr", "pos", "major", "minor")


@query(
    _TOTALS + _MM + f""", s as (select chr, pos, sample, {_N} from r group by all),
j as (select s.chr, s.pos, major, minor, [s.n_a, s.n_c, s.n_g, s.n_t][minor + 1] as n, [s.n_a, s.n_c, s.n_g, s.n_t][minor + 1] + [s.n_a, s.n_c, s.n_g, s.n_t][major + 1] as t from s join mm using (chr, pos))
select chr, pos, major, minor, round(case when major = minor then 0 else greatest(0, sum(case when t > 0 then (n - 0.005 * t) / (t * 0.99) * (2.0 * t / (t + 1)) end) / sum(case when t > 0 then 2.0 * t / (t + 1) end)) end, 6) as phat from j group by chr, pos, major, minor"""
)
def maf_phat(spark: SparkSession, d: str) -> DataFrame:
    r = pileup(spark, d)
    mm = C.major_minor(C.allele_counts(r, ("chr", "pos"))).select("chr", "pos", "major", "minor")
    return C.phat(C.allele_counts(r).join(mm, ["chr", "pos"])).withColumn("phat", F.round("phat", 6))


_PICK = "(pos * 1103515245 + chr * 12345 + {s} * 2654435 + 1) % 2147483647 % (n_a + n_c + n_g + n_t)"
_SAMPLED = f", h as (select chr, pos, sample, {_PICK.format(s='sample')} as k, n_a, n_c, n_g, n_t from c), hb as (select chr, pos, sample, case when k < n_a then 0 when k < n_a + n_c then 1 when k < n_a + n_c + n_g then 2 else 3 end as base from h)"


@query(_COUNTS + _SAMPLED + "select * from hb")
def sampled_bases(spark: SparkSession, d: str) -> DataFrame:
    return C.sampled_base(pileup(spark, d))


@query(_COUNTS + "select chr, pos, sample, case when n_a >= n_c and n_a >= n_g and n_a >= n_t then 0 when n_c >= n_g and n_c >= n_t then 1 when n_g >= n_t then 2 else 3 end as base from c")
def majority_bases(spark: SparkSession, d: str) -> DataFrame:
    return C.majority_base(pileup(spark, d))


@query(
    _COUNTS + _SAMPLED + """, t as (select chr, pos, count(*) as called, count(*) filter (base = 0) as n_a, count(*) filter (base = 1) as n_c, count(*) filter (base = 2) as n_g, count(*) filter (base = 3) as n_t from hb group by all),
k as (select chr, pos, case when n_a >= n_c and n_a >= n_g and n_a >= n_t then 0 when n_c >= n_g and n_c >= n_t then 1 when n_g >= n_t then 2 else 3 end as major from t where called - greatest(n_a, n_c, n_g, n_t) >= 1 and 10 - called <= 2)
select hb.*, major from hb join k using (chr, pos)"""
)
def haplo_calls(spark: SparkSession, d: str) -> DataFrame:
    return C.haplo_call(C.sampled_base(pileup(spark, d)), min_minor=1, max_missing=2, n_samples=10)


@query(
    _TOTALS + """select chr, pos, map {'A':'A','C':'C','G':'G','T':'T','AG':'R','CT':'Y','CG':'S','AT':'W','GT':'K','AC':'M','CGT':'B','AGT':'D','ACT':'H','ACG':'V','ACGT':'N'}[
(case when n_a > 0 then 'A' else '' end || case when n_c > 0 then 'C' else '' end || case when n_g > 0 then 'G' else '' end || case when n_t > 0 then 'T' else '' end)] as code from c"""
)
def iupac_codes(spark: SparkSession, d: str) -> DataFrame:
    return C.iupac_base(pileup(spark, d))


@query(
    _TOTALS + """, b as (select chr, pos, substr('ACGT', case when n_a >= n_c and n_a >= n_g and n_a >= n_t then 1 when n_c >= n_g and n_c >= n_t then 2 when n_g >= n_t then 3 else 4 end, 1) as x from c),
l as (select chr, max(pos) + 1 as len from b group by chr), f as (select chr, unnest(range(len)) as pos from l),
j as (select f.chr, f.pos, coalesce(x, 'N') as x from f left join b on b.chr = f.chr and b.pos = f.pos)
select chr, pos // 50 as line, string_agg(x, '' order by pos) as seq from j group by all"""
)
def consensus_fasta(spark: SparkSession, d: str) -> DataFrame:
    bases = C.majority_base(pileup(spark, d), ("chr", "pos"))
    return C.consensus_lines(bases, bases.groupBy("chr").agg((F.max("pos") + 1).alias("length")))


# filters


@query(f"{CTE} select chr, pos, sample, ord, base, qs from r qualify row_number() over (partition by chr, pos, sample order by ord, base, qs) <= 2")
def filter_cap_depth(spark: SparkSession, d: str) -> DataFrame:
    return C.cap_depth(pileup(spark, d), 2).select("chr", "pos", "sample", "ord", "base", "qs")


@query(f"{CTE}, m as (select chr, pos, case when qs < 20 or posi < 2 or isop < 24 then 4 else base end as base from r) select chr, pos, {_N}, count(*) as n_reads from m group by all")
def filter_mask_bases(spark: SparkSession, d: str) -> DataFrame:
    m = C.mask_bases(pileup(spark, d), 20, 2, 24)
    return m.groupBy("chr", "pos").agg(*(F.count_if(F.col("base") == b).alias(C.N4[b]) for b in range(4)), F.count(F.lit(1)).alias("n_reads"))


@query(_COUNTS + ", x as (select chr, pos, sample, n_a, n_c, n_g, n_t, n_a + n_c + n_g + n_t as d from c) select chr, pos, count(*) filter (d between 2 and 12) as keep, coalesce(sum(d) filter (d between 2 and 12), 0)::bigint as depth from x group by chr, pos having count(*) filter (d between 2 and 12) >= 4 and sum(d) filter (d between 2 and 12) between 10 and 40")
def filter_sites_depth(spark: SparkSession, d: str) -> DataFrame:
    return C.site_filter(C.allele_counts(pileup(spark, d)), 4, 2, 12, 10, 40)


@query(_COUNTS + "select c.* from c where exists (select 1 from part where p_partkey = pos and p_size <= 10)")
def filter_sites_keep(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "part").where("p_size <= 10").selectExpr("p_partkey % 5 as chr", "p_partkey as pos")
    return C.keep_sites(C.allele_counts(pileup(spark, d)), sites)


@query(_COUNTS + "select c.* from c where not exists (select 1 from part where p_partkey = pos and p_size <= 40)")
def filter_sites_complement(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "part").where("p_size <= 40").selectExpr("p_partkey % 5 as chr", "p_partkey as pos")
    return C.keep_sites(C.allele_counts(pileup(spark, d)), sites, complement=True)


@query("select site_id, ref_id as chr, posi as pos from (select distinct site_id, ref_id, posi from site_counts where posi is not null) s where exists (select 1 from regions r where r.ref_id = s.ref_id and s.posi >= r.reg_start and s.posi < r.reg_stop)")
def filter_regions(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "site_counts").where("posi is not null").select("site_id", F.col("ref_id").alias("chr"), F.col("posi").alias("pos")).distinct()
    regions = table(spark, d, "regions").select(F.col("ref_id").alias("chr"), F.col("reg_start").alias("start"), F.col("reg_stop").alias("stop"))
    return C.in_regions(sites, regions)


# aligned reads

_READS = """with f as (select distinct on (read_id) read_id, ref_id, pos, flag, cigar, seq, qual, rg, case when coalesce(mapq, 255) >= 255 then 20 else mapq end as mapq from aligned_reads
where ref_id >= 0 and pos is not null and flag & 1028 = 0 and flag & 512 = 0 and (flag & 1 = 0 or flag & 2 = 2) and regexp_matches(cigar, '[0-9]+[M=X]') and length(seq) > 0)"""


@query(_READS + "select read_id, ref_id, pos, flag, mapq, rg from f where mapq >= 20")
def reads_filtered(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_reads(table(spark, d, "aligned_reads"), min_mapq=20).select("read_id", "ref_id", "pos", "flag", "mapq", "rg")


@query(_READS + "select read_id, ref_id, pos, rg from f where rg in (select distinct rg from aligned_reads where pool_id <= 3)")
def reads_by_group(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "aligned_reads")
    return R.by_group(R.filter_reads(reads), reads.where("pool_id <= 3")).select("read_id", "ref_id", "pos", "rg")


_OPS = _READS + """, o as (select read_id, ref_id, pos, mapq, seq, qual, flag, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') as l from f),
u as (select *, unnest(l) as x, generate_subscripts(l, 1) as i from o),
n as (select *, right(x, 1) as op, left(x, -1)::int as len from u),
b as (select *, coalesce(sum(case when op in ('M','I','S','=','X') then len else 0 end) over w, 0)::int as q_at, (pos - 1 + coalesce(sum(case when op in ('M','D','N','=','X') then len else 0 end) over w, 0))::int as r_at
  from n window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding))
"""


@query(_OPS + "select read_id, op, len, q_at, r_at from b")
def reads_cigar_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.cigar_blocks(R.filter_reads(table(spark, d, "aligned_reads"))).select("read_id", "op", "len", "q_at", "r_at")


_BASES = _OPS + """, e as (select read_id, ref_id as chr, mapq, flag, seq, qual, q_at, r_at, unnest(range(len)) as k from b where op in ('M','=','X') and len > 0),
p as (select read_id, chr, (r_at + k)::int as pos, instr('ACGT', upper(substr(seq, (q_at + k + 1)::bigint, 1))) as c, ascii(substr(qual, (q_at + k + 1)::bigint, 1)) - 33 as qs, flag & 16 > 0 as is_rev from e)
"""


@query(_BASES + "select chr, pos, count(*) as depth, count(*) filter (c = 1) as n_a, count(*) filter (c = 2) as n_c, count(*) filter (c = 3) as n_g, count(*) filter (c = 4) as n_t, count(*) filter (is_rev) as n_rev, sum(qs)::bigint as qs_sum from p group by all")
def reads_pileup(spark: SparkSession, d: str) -> DataFrame:
    bases = R.expand(R.filter_reads(table(spark, d, "aligned_reads")))
    return bases.groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("depth"), *(F.count_if(F.col("base") == b).alias(C.N4[b]) for b in range(4)), F.count_if("is_rev").alias("n_rev"), F.sum("qs").alias("qs_sum"))


@query(_OPS + ", e as (select op, unnest(range(q_at, q_at + case when op in ('D','N','H','P') then 1 else len end)) as place from b where len > 0) select op, place::int as place, count(*) as n from e group by all")
def reads_cigar_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.cigar_profile(R.filter_reads(table(spark, d, "aligned_reads")))


@query(_BASES + ", t as (select read_id, chr, pos, qs, case when is_rev then lower(substr('NACGT', c + 1, 1)) else substr('NACGT', c + 1, 1) end as b from p) select chr, pos + 1 as pos, count(*)::int as depth, string_agg(b, '' order by read_id) as bases, string_agg(chr(qs + 33), '' order by read_id) as quals from t group by t.chr, t.pos".replace("chr(qs", "chr((qs").replace("33),", "33)::int),"))
def reads_pileup_text(spark: SparkSession, d: str) -> DataFrame:
    return R.pileup_text(R.expand(R.filter_reads(table(spark, d, "aligned_reads"))))
