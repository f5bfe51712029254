"""The pileup view over the order tables that most queries use, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociforge.session import table

_COLUMNS = """
  l_partkey % 5 as chr, l_partkey as pos, l_suppkey % 10 as sample,
  cast(case when cast(round(l_discount * 100) as int) < 8 then p_size % 4 else (p_size + 1 + l_linenumber % 3) % 4 end as int) as base,
  cast(13 + cast(l_quantity as int) % 28 as int) as qs, cast(20 + l_linenumber * 5 as int) as mapq,
  cast(round(l_tax * 100) as int) as posi, cast(30 - cast(round(l_tax * 100) as int) as int) as isop,
  l_linestatus = 'F' as is_rev, cast(p_size % 4 as int) as ref, cast((p_size + p_partkey % 7) % 4 as int) as anc,
  l_orderkey * 10 + l_linenumber as ord, l_returnflag as rg
"""
SAMPLES = list(range(10))
#: The view as a common table expression, for the SQL side.
CTE = f"with r as (select {_COLUMNS} from lineitem join part on l_partkey = p_partkey)"


def pileup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each base: chr, pos, sample, base, qs, mapq, posi, isop, is_rev, ref, anc, ord, rg."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.selectExpr(*[x.strip() for x in _split(_COLUMNS)])


def _split(columns: str) -> list[str]:
    """Select items of a list in SQL, cut at the commas outside of brackets."""
    out, depth, item = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]
