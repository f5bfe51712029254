"""Writers: text tables in range-partitioned order of position, and the columnar forms."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.genotypes import base_letter


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows range-partitioned and sorted, so that part files follow each other in order."""
    keys = keys or ("chr", "pos")
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_tsv(df: DataFrame, path: str, *keys: str, header: bool = True) -> None:
    """A compressed tab-separated table in order."""
    ordered(df, *keys).write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip", nullValue="NA", emptyValue="")


def mafs(freq: DataFrame, value: str = "knownEM", **more: str) -> DataFrame:
    """``chromo, position`` (1-based) ``, major, minor, [ref, anc,] <value>, [further estimates,] nInd`` of positions with major, minor, freq and n.

    ``more`` names further estimates: heading = column."""
    own = [base_letter(F.col(c)).alias(c) for c in ("ref", "anc") if c in freq.columns]
    values = [F.format_string("%.6f", c).alias(h) for h, c in {value: "freq", **more}.items()]
    return freq.select(F.col("chr").alias("chromo"), (F.col("pos") + 1).alias("position"), base_letter(F.col("major")).alias("major"), base_letter(F.col("minor")).alias("minor"), *own, *values, F.col("n").alias("nInd"))


def beagle_lines(post: DataFrame, samples: list) -> DataFrame:
    """Lines of a genotype-probability file from long posteriors; samples without one get 1/3 each."""
    m = F.map_from_entries(F.collect_list(F.struct("sample", F.array("p0", "p1", "p2").alias("p"))))
    g = post.groupBy("chr", "pos", "major", "minor").agg(m.alias("m"))
    third = F.array(*[F.lit(1 / 3)] * 3)
    cells = F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(s).cast(dict(post.dtypes)["sample"])), third) for s in samples)))
    return g.select("chr", "pos", F.concat_ws("\t", F.concat_ws("_", "chr", F.col("pos") + 1), F.col("major"), F.col("minor"), F.array_join(F.transform(cells, lambda x: F.format_string("%.6f", x)), "\t")).alias("value"))


def tped_lines(calls: DataFrame, samples: list) -> DataFrame:
    """Lines of transposed PLINK text from long genotype calls (chr, pos, major, minor, sample, geno)."""
    m = F.map_from_entries(F.collect_list(F.struct("sample", "geno")))
    g = calls.groupBy("chr", "pos", "major", "minor").agg(m.alias("m"))
    a, b = base_letter(F.col("major")), base_letter(F.col("minor"))

    def pair(s) -> Column:
        x = F.try_element_at("m", F.lit(s).cast(dict(calls.dtypes)["sample"]))
        return F.when(x == 0, F.concat_ws(" ", a, a)).when(x == 1, F.concat_ws(" ", a, b)).when(x == 2, F.concat_ws(" ", b, b)).otherwise("0 0")

    return g.select("chr", "pos", F.concat_ws(" ", F.col("chr"), F.concat_ws("_", "chr", F.col("pos") + 1), F.lit("0"), F.col("pos") + 1, *(pair(s) for s in samples)).alias("value"))


def tfam_lines(samples: list[str]) -> list[str]:
    """Lines of the PLINK sample file."""
    return [f"{s} {s} 0 0 0 -9" for s in samples]


def bed_bytes(genos: np.ndarray) -> bytes:
    """The body of a PLINK bed file (with its magic bytes) of genotypes (sites x samples; minor alleles, -1 missing)."""
    code = np.array([3, 2, 0, 1], np.uint8)[np.asarray(genos)]
    pad = -code.shape[1] % 4
    code = np.pad(code, ((0, 0), (0, pad)))
    quads = code.reshape(len(code), -1, 4)
    return b"\x6c\x1b\x01" + (quads << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8).tobytes()


def bed_rows(calls: DataFrame, samples: list) -> DataFrame:
    """``chr, pos, value``: each position's bytes of a PLINK bed file, for ``write_binary``; the three magic bytes come before the first."""
    m = F.map_from_entries(F.collect_list(F.struct("sample", F.col("geno").cast("int").alias("geno"))))
    kind = dict(calls.dtypes)["sample"]
    g = calls.groupBy("chr", "pos").agg(m.alias("m")).select("chr", "pos", F.array(*(F.coalesce(F.try_element_at("m", F.lit(s).cast(kind)), F.lit(-1)) for s in samples)).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = -(-len(samples) // 4)
            data = bed_bytes(np.asarray(b["g"].flatten()).reshape(b.num_rows, len(samples)))[3:]
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], pa.array([data[i * width : (i + 1) * width] for i in range(b.num_rows)], pa.binary())], ["chr", "pos", "value"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, value binary")


def bim_lines(alleles: DataFrame) -> DataFrame:
    """Lines of the PLINK position file: minor allele first."""
    return alleles.select("chr", "pos", F.concat_ws("\t", F.col("chr"), F.concat_ws("_", "chr", F.col("pos") + 1), F.lit("0"), F.col("pos") + 1, base_letter(F.col("minor")), base_letter(F.col("major"))).alias("value"))


def vcf_full_lines(calls: DataFrame, samples: list) -> DataFrame:
    """Data lines of a VCF with GT:DP:GL:PL:GP and INFO NS, DP, AF: long rows chr, pos, major, minor, sample, geno, depth, l0, l1, l2 (likelihoods
    relative to the largest), p0, p1, p2."""
    six = lambda *cs: F.array_join(F.array(*(F.format_string("%.6f", c) for c in cs)), ",")
    logs = [F.log10(F.greatest(F.col(f"l{k}"), F.lit(1e-300))) for k in range(3)]
    phred = F.array_join(F.array(*(F.least(F.lit(255), F.round(-10 * x)).cast("int").cast("string") for x in logs)), ",")
    gt = F.when(F.col("geno") == 0, "0/0").when(F.col("geno") == 1, "0/1").when(F.col("geno") == 2, "1/1").otherwise("./.")
    cell = F.concat_ws(":", gt, F.col("depth"), six(*logs), phred, six("p0", "p1", "p2"))
    m = F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("v"))))
    g = calls.groupBy("chr", "pos", "major", "minor").agg(m.alias("m"), F.count(F.lit(1)).alias("ns"), F.sum("depth").alias("dp"), (F.avg(F.col("p1") + 2 * F.col("p2")) / 2).alias("af"))
    kind = dict(calls.dtypes)["sample"]
    cells = [F.coalesce(F.try_element_at("m", F.lit(s).cast(kind)), F.lit("./.:.:.:.:.")) for s in samples]
    info = F.concat(F.lit("NS="), F.col("ns"), F.lit(";DP="), F.col("dp"), F.lit(";AF="), F.format_string("%.6f", "af"))
    return g.select("chr", "pos", F.concat_ws("\t", F.col("chr"), F.col("pos") + 1, F.lit("."), base_letter(F.col("major")), base_letter(F.col("minor")), F.lit("."), F.lit("PASS"), info, F.lit("GT:DP:GL:PL:GP"), *cells).alias("value"))


def vcf_lines(post: DataFrame, samples: list, freq: DataFrame | None = None) -> DataFrame:
    """Data lines of a VCF with GT and GP from long posteriors (major as reference)."""
    m = F.map_from_entries(F.collect_list(F.struct("sample", F.array("p0", "p1", "p2").alias("p"))))
    g = post.groupBy("chr", "pos", "major", "minor").agg(m.alias("m"), F.count(F.lit(1)).alias("ns"), (F.avg(F.col("p1") + 2 * F.col("p2")) / 2).alias("af"))

    def cell(s) -> Column:
        p = F.try_element_at("m", F.lit(s).cast(dict(post.dtypes)["sample"]))
        top = F.array_position(p, F.array_max(p))
        gt = F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), top.cast("int"))
        return F.when(p.isNull(), "./.:.").otherwise(F.concat(gt, F.lit(":"), F.array_join(F.transform(p, lambda x: F.format_string("%.6f", x)), ",")))

    info = F.concat(F.lit("NS="), F.col("ns"), F.lit(";AF="), F.format_string("%.6f", "af"))
    return g.select("chr", "pos", F.concat_ws("\t", F.col("chr"), F.col("pos") + 1, F.lit("."), base_letter(F.col("major")), base_letter(F.col("minor")), F.lit("."), F.lit("PASS"), info, F.lit("GT:GP"), *(cell(s) for s in samples)).alias("value"))


def vcf_header(samples: list[str], contigs: list[tuple[str, int]]) -> list[str]:
    """Header lines of such a VCF."""
    return [
        "##fileformat=VCFv4.2", *(f"##contig=<ID={c},length={n}>" for c, n in contigs), '##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples with data">',
        '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=GP,Number=G,Type=Float,Description="Genotype probabilities">',
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
        '##FORMAT=<ID=GL,Number=G,Type=Float,Description="Log10 genotype likelihoods">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Phred-scaled genotype likelihoods">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def write_lines(lines: DataFrame, path: str) -> None:
    """The ``value`` column as text, in order of chr and pos."""
    ordered(lines).select("value").write.mode("overwrite").text(path, compression="gzip")


def square(pairs: DataFrame, value: str) -> DataFrame:
    """A matrix ``i, c0, c1, ...`` of a table of pairs i <= j (symmetric)."""
    both = pairs.select("i", "j", value).unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), value))
    ids = sorted(r[0] for r in pairs.select("i").union(pairs.select("j")).distinct().collect())
    return both.groupBy("i").agg(*(F.max(F.when(F.col("j") == k, F.col(value))).alias(f"c{k}") for k in ids))


def split_samples(likes: DataFrame, column: str, width: int, first: int, last: int) -> DataFrame:
    """Samples first to last (inclusive) of a flat likelihood array."""
    return likes.withColumn(column, F.slice(column, F.lit(first * width + 1), F.lit((last - first + 1) * width)))


def write_log(path: str, **parameters) -> None:
    """The parameters of a run beside its results."""
    Path(path).write_text(json.dumps(parameters, indent=1, sort_keys=True, default=str))
