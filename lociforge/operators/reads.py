"""Filters on aligned reads and their expansion into bases.

Columns used: read_id, flag, ref_id, pos (1-based), mapq, cigar, seq, qual, rg.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.genotypes import base_code

#: Qualities that stand for a missing mapping or base quality.
MISSING_MAPQ, MISSING_QS = 20, 23


def filter_reads(reads: DataFrame, remove_bad: bool = True, only_proper: bool = True, min_mapq: int = 0, sample: float | None = None, seed: int = 1) -> DataFrame:
    """Usable reads: mapped, no duplicates, with sequence and an aligned block, and past the chosen filters; once by read_id."""
    f = F.col("flag")
    r = reads.where("ref_id >= 0 and pos is not null and flag & 1028 = 0 and cigar rlike '[0-9]+[M=X]' and length(seq) > 0")
    if remove_bad:
        r = r.where("flag & 512 = 0")
    if only_proper:
        r = r.where((f.bitwiseAND(1) == 0) | (f.bitwiseAND(2) == 2))
    r = r.withColumn("mapq", F.when(F.coalesce("mapq", F.lit(255)) >= 255, MISSING_MAPQ).otherwise(F.col("mapq"))).where(F.col("mapq") >= min_mapq)
    if sample is not None:
        r = r.where(F.pmod(F.xxhash64("read_id", F.lit(seed)), F.lit(1_000_000)) < int(sample * 1_000_000))
    return r.dropDuplicates(["read_id"])


def by_group(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Reads whose read group is listed."""
    return reads.join(groups.select("rg").distinct(), "rg", "left_semi")


def unique_only(reads: DataFrame) -> DataFrame:
    """Reads whose X0 tag (column ``tags``, a map) is 1."""
    return reads.where(F.try_element_at("tags", F.lit("X0")) == "1")


def cap_mapq(reads: DataFrame, bases: DataFrame, thres: int = 50) -> DataFrame:
    """Mapping quality capped by the mismatches of a read: ``bases`` are its expanded bases with a ``ref`` column.

    The cap is lowered by the qualities of mismatching bases, corrected for the number of ways to place them; reads whose cap falls
    below zero are dropped.
    """
    mm = (F.col("base") != F.col("ref")) & F.col("base").between(0, 3) & F.col("ref").between(0, 3) & (F.col("qs") >= 13)
    per = bases.groupBy("read_id").agg(F.count_if(F.col("base").between(0, 3)).alias("len"), F.count_if(mm).alias("mm"), F.sum(F.when(mm, F.least("qs", F.lit(33)))).alias("q"))
    ways = F.aggregate(F.sequence(F.lit(1), F.greatest("mm", F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= F.col("mm"), 10 * F.log10((F.col("len") - i + 1) / i.cast("double"))).otherwise(0.0))
    t = F.coalesce(F.col("q"), F.lit(0)) - ways
    left = thres - F.greatest(t, F.lit(0.0))
    cap = F.when(left >= 0, F.sqrt(left / thres) * thres)
    return reads.join(per.select("read_id", cap.alias("__cap")), "read_id").where("__cap is not null").withColumn("mapq", F.least("mapq", F.floor("__cap").cast("int"))).drop("__cap")


def cigar_blocks(reads: DataFrame) -> DataFrame:
    """One row for each CIGAR operation: ``op, len``, its start in the read (``q_at``) and on the reference (``r_at``, 0-based)."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    start = F.struct(F.lit(0).alias("q"), (F.col("pos") - 1).cast("int").alias("r"), F.array().cast("array<struct<op:string,n:int,q:int,r:int>>").alias("out"))

    def step(a, x):
        uses_q, uses_r = x["op"].isin("M", "I", "S", "=", "X"), x["op"].isin("M", "D", "N", "=", "X")
        return F.struct(
            (a["q"] + F.when(uses_q, x["n"]).otherwise(0)).alias("q"), (a["r"] + F.when(uses_r, x["n"]).otherwise(0)).alias("r"),
            F.array_append(a["out"], F.struct(x["op"].alias("op"), x["n"].alias("n"), a["q"].alias("q"), a["r"].alias("r"))).alias("out"),
        )

    blocks = F.aggregate(ops, start, step, lambda a: a["out"])
    rest = [c for c in reads.columns]
    return reads.select(*rest, F.explode(blocks).alias("__b")).select(*rest, F.col("__b.op").alias("op"), F.col("__b.n").alias("len"), F.col("__b.q").alias("q_at"), F.col("__b.r").alias("r_at"))


def expand(reads: DataFrame, min_q: int = 0) -> DataFrame:
    """Aligned bases ``read_id, chr, pos`` (0-based) ``, base, qs, mapq, posi, isop, is_rev, rg``; low qualities become N (4)."""
    at = F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("__k")
    b = cigar_blocks(reads).where("op in ('M', '=', 'X') and len > 0").select("*", at)
    i = F.col("q_at") + F.col("__k")
    q = F.ascii(F.substring("qual", i + 1, F.lit(1))) - 33
    q = F.when(q >= 222, MISSING_QS).otherwise(q)
    base = F.coalesce(base_code(F.substring("seq", i + 1, F.lit(1))), F.lit(4))
    return b.select("read_id", F.col("ref_id").alias("chr"), (F.col("r_at") + F.col("__k")).alias("pos"), F.when(q < min_q, 4).otherwise(base).alias("base"), q.alias("qs"),
                    "mapq", i.alias("posi"), (F.length("seq") - 1 - i).alias("isop"), (F.col("flag").bitwiseAND(16) > 0).alias("is_rev"), "rg")


def cigar_profile(reads: DataFrame) -> DataFrame:
    """How often each CIGAR operation covers each place in the read."""
    b = cigar_blocks(reads).where("len > 0")
    at = F.explode(F.sequence("q_at", F.col("q_at") + F.when(F.col("op").isin("D", "N", "H", "P"), 0).otherwise(F.col("len") - 1))).alias("place")
    return b.select("op", at).groupBy("op", "place").agg(F.count(F.lit(1)).alias("n"))


def pileup_text(bases: DataFrame) -> DataFrame:
    """Text pileup ``chr, pos`` (1-based) ``, depth, bases, quals``: lower case on the reverse strand, ordered by read."""
    letter = F.when(F.col("base").between(0, 3), F.substring(F.lit("ACGT"), F.col("base") + 1, F.lit(1))).otherwise("N")
    letter = F.when(F.col("is_rev"), F.lower(letter)).otherwise(letter)
    cells = F.sort_array(F.collect_list(F.struct("read_id", letter.alias("b"), F.chr(F.col("qs") + 33).alias("q"))))
    g = bases.groupBy("chr", "pos").agg(cells.alias("c"))
    return g.select("chr", (F.col("pos") + 1).alias("pos"), F.size("c").alias("depth"), F.array_join("c.b", "").alias("bases"), F.array_join("c.q", "").alias("quals"))
