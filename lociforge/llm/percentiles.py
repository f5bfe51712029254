"""Percentiles of large numeric columns from mergeable group-value counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.session import cut


def value_counts(df: DataFrame, groups: list[str], value: str, weight: str | None = None, digits: int | None = None) -> DataFrame:
    """The mergeable summary ``groups..., value, n``: how often each value occurs in each group.

    Null and NaN values don't count; null groups form a group of their own; ``weight`` names a column of row counts (null or
    non-positive: the row doesn't count).  With ``digits`` values are rounded to so many significant digits, which bounds the
    summary's size to a few thousand rows a group and the relative error of any percentile to 0.5 * 10**(1 - digits); without
    it percentiles are exact.  Summaries of separate loads, partitions or days combine with ``merge_counts``.
    """
    v = F.col(value)
    kept = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    if digits is not None:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v.cast("double")))) - (digits - 1))
        v = F.when(v == 0, F.lit(0.0)).otherwise(F.round(v / unit) * unit)
    n = F.lit(1) if weight is None else F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))
    return kept.groupBy(*groups, v.alias("value")).agg(F.sum(n).cast("bigint").alias("n")).where("n > 0")


def merge_counts(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """One summary of all ``parts``, as if it had been made from all their rows at once."""
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(*groups, "value").agg(F.sum("n").cast("bigint").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], targets: list[float]) -> DataFrame:
    """``groups..., total, p<q>...`` from a summary: p<q> is the smallest value that at least q % of the values do not exceed.

    The counts are range-sorted on (group, value), so a group that owns most values is cut over many partitions.  The sorted
    table is written once; each partition's running sums get the totals of the group's earlier partitions as an offset, and
    the value whose cumulative count first reaches a target rank is picked.  An empty summary gives an empty result.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written out, since the range bounds come from a sample: both uses below must see one and the same cut
    ranged = cut(counts.repartitionByRange(parts, *groups, "value").withColumn("__part", F.spark_partition_id()))
    by = [*groups, "__part"]
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by).agg(F.sum("n").alias("__sum"))
    sums = sums.withColumns({"__offset": F.coalesce(F.sum("__sum").over(before), F.lit(0)), "total": F.sum("__sum").over(Window.partitionBy(*groups))})
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranged.withColumn("__running", running)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    rows = rows.alias("r").join(sums.alias("s"), same).select("r.*", "s.__offset", "s.total")
    upto = F.col("__offset") + F.col("__running")
    first = {q: (upto * 100 >= F.lit(q) * F.col("total")) & ((upto - F.col("n")) * 100 < F.lit(q) * F.col("total")) for q in targets}
    hit = reduce(lambda a, b: a | b, first.values())
    picked = rows.select(*groups, "total", *(F.when(c, F.col("value")).alias(name(q)) for q, c in first.items()), hit.alias("__hit")).where("__hit")
    return picked.groupBy(*groups).agg(F.max("total").alias("total"), *(F.max(name(q)).alias(name(q)) for q in targets))


def name(q: float) -> str:
    """Column name of a percentile: 50 -> p50, 99.9 -> p99_9."""
    return "p" + f"{q:g}".replace(".", "_")


def site_values(sites: DataFrame, group: str) -> DataFrame:
    """``group, field, value, n`` of sequencing sites: the fields ``depth`` (sum of the non-null counts) and ``posi``.

    A site delivered again (same site_id) counts once; sites without an id cannot be recognised and all count.
    """
    depth = F.when(F.col("counts").isNotNull(), F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))))
    once = sites.select("site_id", F.col(group), F.col("posi").cast("bigint"), depth.alias("depth")).groupBy("site_id", group, "posi", "depth").agg(F.count(F.lit(1)).alias("__n"))
    n = F.when(F.col("site_id").isNull(), F.col("__n")).otherwise(1)
    fields = F.array(F.struct(F.lit("depth").alias("field"), F.col("depth").alias("v")), F.struct(F.lit("posi").alias("field"), F.col("posi").alias("v")))
    long = once.select(group, n.alias("__n"), F.explode(fields).alias("__f")).select(group, "__n", "__f.field", "__f.v")
    return value_counts(long, [group, "field"], "v", "__n")


def skewed_groups(p: DataFrame, group: str) -> DataFrame:
    """Groups and fields whose upper half is more than four times as wide as the lower: P95 - P50 > 4 (P50 - P5)."""
    return p.where("p95 - p50 > 4 * (p50 - p5)").select(group, "field")
