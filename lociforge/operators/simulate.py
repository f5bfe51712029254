"""Simulated data from hashes: any partition of any run gives the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    cols = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def simulate_reads(spark: SparkSession, n_sites: int, n_samples: int, depth: float = 4.0, error: float = 0.01, variable: float = 0.1, fst: float = 0.0, seed: int = 1) -> DataFrame:
    """Bases ``chr, pos, sample, pop, base, qs, ref`` of two populations of samples (even and odd) with known truth ``freq`` (of the population).

    Variable positions have a frequency that falls as 1 / x between 1 / (2 n) and 1; with ``fst`` the populations drift apart from it
    about evenly to both sides.  Depth is binomial around its mean, and errors are spread evenly over the other bases.
    """
    most = max(1, int(3 * depth))
    low = 1 / (2 * n_samples)
    sites = spark.range(n_sites).select(F.lit(1).alias("chr"), F.col("id").alias("pos"), F.floor(uniform("id", seed, 1) * 4).cast("int").alias("ref"))
    x = F.pow(F.lit(low), 1 - uniform("pos", seed, 2))
    sites = sites.withColumn("f", F.when(uniform("pos", seed, 3) < variable, x).otherwise(0.0)).withColumn("alt", ((F.col("ref") + 1 + F.floor(uniform("pos", seed, 4) * 3)) % 4).cast("int"))
    rows = sites.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("pop", F.col("sample") % 2)
    drift = (uniform("pos", "pop", seed, 5) - 0.5) * 2 * F.sqrt(F.lit(3 * fst) * F.col("f") * (1 - F.col("f")))
    rows = rows.withColumn("freq", F.when(F.col("f") > 0, F.least(F.greatest(F.col("f") + drift, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    rows = rows.withColumn("geno", (uniform("pos", "sample", seed, 6) < F.col("freq")).cast("int") + (uniform("pos", "sample", seed, 7) < F.col("freq")).cast("int"))
    reads = rows.withColumn("read", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(uniform("pos", "sample", "read", seed, 8) < depth / most)
    true = F.when(uniform("pos", "sample", "read", seed, 9) * 2 < F.col("geno"), F.col("alt")).otherwise(F.col("ref"))
    wrong = uniform("pos", "sample", "read", seed, 10) < error
    base = F.when(wrong, (true + 1 + F.floor(uniform("pos", "sample", "read", seed, 11) * 3)) % 4).otherwise(true).cast("int")
    q = F.round(-10 * F.log10(F.lit(error))).cast("int")
    return reads.select("chr", "pos", "sample", "pop", base.alias("base"), q.alias("qs"), "ref", "freq", "geno", "read")
