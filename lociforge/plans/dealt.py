"""Queries of the general data-preparation operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.badrows import parse_records
from lociforge.operators.intervals import clean_regions, periods_and_gaps
from lociforge.operators.skew import dominant_contigs, reads_per_contig
from lociforge.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = clean_regions(table(spark, d, "regions"), table(spark, d, "contigs"))
    return periods_and_gaps(rows, ["list_id", "ref_id"], "reg_start", "reg_stop").select("list_id", "ref_id", "kind", F.col("reg_start").cast("int"), F.col("reg_stop").cast("int"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(table(spark, d, "hapmap_lines")).where("reason is not null").select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = parse_records(table(spark, d, "hapmap_lines"), keep=("line_id", "file_id", "line_no")).where("reason is null")
    return loaded.select("line_id", "file_id", "line_no", "posi", "allele1", F.round("freq", 6).alias("freq"), "strand", "allele2", "note")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_contigs(table(spark, d, "aligned_reads"))


def p5_contigs(spark: SparkSession, d: str) -> DataFrame:
    return reads_per_contig(table(spark, d, "aligned_reads"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_loaded": p3_loaded, "p5_found": p5_found, "p5_contigs": p5_contigs}

_P3 = r"""
with l as (select line_id, file_id, line_no, regexp_replace(coalesce(raw_line, ''), '\r$', '') as s from hapmap_lines),
f as (select *, regexp_full_match(s, '(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^",]*|))*', 's') as whole,
  regexp_extract_all(s || ',', '("(?:[^"]|"")*"|[^",][^",]*|),', 1, 's') as raw from l),
v as (select *, list_transform(raw, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else trim(x, ' ' || chr(9)) end) as c from f),
r as (select line_id, file_id, line_no, c, case when not whole then 'quoting' when len(c) <> 6 then 'column_count'
  when not (regexp_full_match(c[1], '[0-9]+') and regexp_matches(c[1], '[1-9]')) then 'posi'
  when not regexp_full_match(c[2], '[ACGTacgt]') then 'allele1'
  when not (regexp_full_match(c[3], '([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(c[3] as double) between 0 and 1) then 'freq'
  when not regexp_full_match(c[4], '[+-]') then 'strand' when not regexp_full_match(c[5], '[ACGTacgt]') then 'allele2' end as reason from v)
"""

_P5 = """
with u as (select distinct read_id, pool_id, ref_id, pos from aligned_reads where ref_id >= 0 and pos is not null and flag & 4 = 0),
s as (select pool_id, ref_id, pos, count(*) as n from u group by all),
k as (select pool_id, ref_id, sum(n)::bigint as n_reads, count(*) as n_starts, min(pos)::bigint as first_start, max(pos)::bigint as last_start,
  -max({'n': n, 'neg': -pos}).neg::bigint as top_start, max(n) as top_reads from s group by all),
t as (select *, (sum(n_reads) over (partition by pool_id))::bigint as pool_reads from k)
"""

SQL = {
    "p1_found": """
with r as (select list_id, ref_id, greatest(coalesce(reg_start, 0), 0) as a, least(coalesce(reg_stop, length), length) as b
  from regions join contigs using (ref_id)),
v as (select distinct * from r where b > a),
m as (select *, max(b) over (partition by list_id, ref_id order by a, b rows between unbounded preceding and 1 preceding) as p from v),
i as (select *, sum(case when p is null or a > p then 1 else 0 end) over (partition by list_id, ref_id order by a, b rows unbounded preceding) as g from m),
q as (select list_id, ref_id, min(a) as a, max(b) as b from i group by list_id, ref_id, g),
n as (select *, lead(a) over (partition by list_id, ref_id order by a) as nx from q)
select list_id, ref_id, 'period' as kind, a::int as reg_start, b::int as reg_stop from n
union all select list_id, ref_id, 'gap', b::int, nx::int from n where nx is not null
""",
    "p3_found": _P3 + "select line_id, reason from r where reason is not null",
    "p3_loaded": _P3
    + "select line_id, file_id, line_no, c[1]::bigint as posi, upper(c[2]) as allele1, round(c[3]::double, 6) as freq, c[4] as strand, upper(c[5]) as allele2, c[6] as note from r where reason is null",
    "p5_found": _P5 + "select pool_id, ref_id from t where n_reads >= 0.25 * pool_reads",
    "p5_contigs": _P5 + "select * from t",
}
