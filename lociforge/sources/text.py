"""Readers of text formats; every reader returns a lazily evaluated DataFrame and splits its files over tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import GENOTYPES, base_code

#: The forms of a region and the missing value of phenotype files.
REGION = re.compile(r"^(?P<chr>.+?)(?::(?P<a>\d*)(?P<dash>-?)(?P<b>\d*))?$")
MISSING = -999.0


def _fields(line: str = "value") -> Column:
    return F.split(F.trim(line), r"\s+")


def _site(marker: Column) -> tuple[Column, Column]:
    """Contig and position of ``<contig>_<pos>``, cut at the last underscore."""
    return F.regexp_extract(marker, r"^(.*)_(\d+)$", 1), F.regexp_extract(marker, r"^(.*)_(\d+)$", 2).cast("int")


def _triples(cells: Column, width: int, kind: str = "double") -> Column:
    """A flat array of strings as an array of arrays of ``width`` numbers."""
    n = F.floor(F.size(cells) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.slice(cells, i * width + 1, F.lit(width)), lambda x: x.cast(kind)))


def beagle(spark: SparkSession, path: str) -> DataFrame:
    """Genotype probabilities: ``chr, pos`` (0-based) ``, major, minor, probs`` (three for each sample).  The header line is skipped."""
    t = spark.read.text(path).where("value not like 'marker%' and length(trim(value)) > 0").select(_fields().alias("f"))
    chrom, pos = _site(F.col("f")[0])
    cells = F.slice("f", F.lit(4), F.greatest(F.size("f") - 3, F.lit(0)))
    return t.where("size(f) >= 6").select(chrom.alias("chr"), (pos - 1).alias("pos"), base_code(F.col("f")[1]).alias("major"), base_code(F.col("f")[2]).alias("minor"), _triples(cells, 3).alias("probs"))


def glf_text(spark: SparkSession, path: str) -> DataFrame:
    """Log likelihoods of ten genotypes for each sample: ``chr, pos, sample, gl``."""
    t = spark.read.text(path).where("length(trim(value)) > 0").select(_fields().alias("f"))
    chrom, pos = _site(F.col("f")[0])
    cells = F.slice("f", F.lit(2), F.size("f") - 1)
    return t.select(chrom.alias("chr"), (pos - 1).alias("pos"), F.posexplode(_triples(cells, 10)).alias("sample", "gl"))


def mpileup(spark: SparkSession, path: str, min_q: int = 0) -> DataFrame:
    """Bases of a text pileup: ``chr, pos`` (0-based) ``, sample, base, qs, mapq, posi, isop, is_rev, ref, ord``.

    Read starts (with their mapping quality), ends and indels carry no base; ``.`` and ``,`` stand for the reference base, ``*`` for a
    deletion, which is left out.  Mapping quality and read positions aren't in the format: they are 30 and 255.
    """
    t = spark.read.text(path).where("length(trim(value)) > 0").select(F.split("value", "\t").alias("f"))
    n = F.floor((F.size("f") - 3) / 3).cast("int")
    t = t.select(F.col("f")[0].alias("chr"), (F.col("f")[1].cast("int") - 1).alias("pos"), F.col("f")[2].alias("r"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at("f", 5 + 3 * i).alias("b"), F.element_at("f", 6 + 3 * i).alias("q")))).alias("sample", "s"))
    plain = F.regexp_replace(F.col("s.b"), r"\^.|\$", "")
    # an indel is a sign, a length and so many letters: rewritten length by length, as the pattern language can't count
    sizes = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"[+-](\d+)"), F.lit(1)), lambda x: x.cast("int")))
    clean = F.reduce(sizes, plain, lambda s, k: F.call_function("regexp_replace", s, F.concat(F.lit(r"[+-]"), k.cast("string"), F.lit("[A-Za-z*#]{"), k.cast("string"), F.lit("}")), F.lit("")))
    t = t.withColumn("letters", F.split(clean, "")).select("*", F.posexplode("letters").alias("ord", "x")).where("length(x) = 1 and x not in ('*', '#', '>', '<')")
    letter = F.when(F.col("x").isin(".", ","), F.col("r")).otherwise(F.col("x"))
    q = F.ascii(F.substring("s.q", F.col("ord") + 1, F.lit(1))) - 33
    base = F.coalesce(base_code(letter), F.lit(4))
    rev = (F.col("x") == ",") | F.col("x").rlike("^[acgtn]$")
    return t.select("chr", "pos", "sample", F.when(q < min_q, 4).otherwise(base).alias("base"), q.alias("qs"), F.lit(30).alias("mapq"), F.lit(255).alias("posi"), F.lit(255).alias("isop"), rev.alias("is_rev"), base_code(F.col("r")).alias("ref"), "ord")


def vcf(spark: SparkSession, path: str, field: str = "PL") -> DataFrame:
    """Likelihoods or probabilities of a VCF: PL and GL give ``chr, pos, sample, gl`` (ten), GP ``chr, pos, major, minor, sample, p0, p1, p2``.

    Indels and spanning deletions are left out; genotypes of absent alleles get the lowest likelihood; a sample whose values are
    missing gets equal ones.
    """
    t = spark.read.text(path).where("value not like '#%'").select(F.split("value", "\t").alias("f"))
    f = F.col("f")
    alleles = F.concat(F.array(f[3]), F.filter(F.split(f[4], ","), lambda a: ~a.isin(".", "<*>", "<X>", "<NON_REF>")))
    t = t.where(~f[7].rlike("(^|;)INDEL(;|$)")).withColumn("alleles", alleles).where(~F.exists("alleles", lambda a: (F.length(a) != 1) | (a == "*")))
    at = F.array_position(F.split(f[8], ":"), F.lit(field)).cast("int")
    t = t.where(at > 0).select(f[0].alias("chr"), (f[1].cast("int") - 1).alias("pos"), F.transform("alleles", base_code).alias("codes"), F.posexplode(F.transform(F.slice("f", F.lit(10), F.size("f") - 9), lambda s: F.try_element_at(F.split(s, ":"), at))).alias("sample", "v"))
    cells = F.transform(F.split("v", ","), lambda x: x.try_cast("double"))
    t = t.withColumn("cells", cells)
    if field == "GP":
        p = [F.try_element_at("cells", F.lit(i + 1)) for i in range(3)]
        return t.where("size(codes) = 2").select("chr", "pos", F.col("codes")[0].alias("major"), F.col("codes")[1].alias("minor"), "sample", *(F.coalesce(x, F.lit(1 / 3)).alias(f"p{i}") for i, x in enumerate(p)))
    scale = -0.23025850929940458 if field == "PL" else 2.302585092994046
    # order in the file: genotype (j, k), j <= k, is number k (k + 1) / 2 + j
    def cell(a: int, b: int) -> Column:
        i, j = F.array_position("codes", F.lit(a)).cast("int") - 1, F.array_position("codes", F.lit(b)).cast("int") - 1
        lo, hi = F.least(i, j), F.greatest(i, j)
        return F.when(lo >= 0, F.try_element_at("cells", (hi * (hi + 1) / 2 + lo + 1).cast("int")) * scale)

    raw = [cell(a, b) for a, b in GENOTYPES]
    t = t.select("chr", "pos", "sample", F.array(*raw).alias("raw"))
    top = F.array_max("raw")
    flat = F.array_min(F.filter("raw", lambda x: x.isNotNull())) == top
    gl = F.transform("raw", lambda x: F.when(top.isNull() | flat, 0.0).otherwise(F.coalesce(x - top, F.lit(-1e30))))
    return t.select("chr", "pos", "sample", gl.alias("gl"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text: ``read_id, qname, flag, chr, pos`` (1-based) ``, mapq, cigar, rnext, pnext, tlen, seq, qual, rg, tags``."""
    t = spark.read.text(path).where("value not like '@__\t%' and length(value) > 0").select(F.xxhash64("value").alias("read_id"), F.split("value", "\t").alias("f"))
    f = F.col("f")
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v"))))
    t = t.select("read_id", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chr"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[6].alias("rnext"), f[7].cast("int").alias("pnext"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"))
    return t.withColumn("rg", F.try_element_at("tags", F.lit("RG")))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines ``kind, tags`` (map)."""
    t = spark.read.text(path).where("value like '@__\t%'").select(F.split("value", "\t").alias("f"))
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(4), F.length(x)).alias("v"))))
    return t.select(F.substring(F.col("f")[0], 2, 2).alias("kind"), tags.alias("tags"))


def check_headers(spark: SparkSession, paths: list[str]) -> None:
    """Raises unless all files are sorted by coordinate and name the same contigs with the same lengths."""
    seen = None
    for p in paths:
        rows = sam_header(spark, p).collect()
        if not any(r["kind"] == "HD" and r["tags"].get("SO") == "coordinate" for r in rows):
            raise ValueError(f"{p} isn't sorted by coordinate")
        contigs = [(r["tags"]["SN"], r["tags"]["LN"]) for r in rows if r["kind"] == "SQ"]
        if seen is not None and contigs != seen:
            raise ValueError(f"{p} has other contigs")
        seen = contigs


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sequence with their place: ``chr, start, seq``.

    Files are read in splits.  Lines are placed within their split; what the earlier splits of a file carry over (contig, and length since
    its header) comes from one summary row a split, so no task sees a whole contig.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    t = t.withColumn("seq", F.trim("value")).where("length(seq) > 0")
    head = F.when(F.col("seq").startswith(">"), F.regexp_extract("seq", r"^>(\S*)", 1))
    t = t.withColumns({"head": head, "len": F.when(head.isNull(), F.length("seq")).otherwise(0)})
    by = ["file", "split"]
    inside = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"own": F.last("head", ignorenulls=True).over(inside), "part": F.count("head").over(inside)})
    t = t.withColumn("before", F.sum("len").over(Window.partitionBy(*by, "part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    ends = t.groupBy(*by).agg(F.max_by("own", "id").alias("last"), F.max_by(F.col("before") + F.col("len"), F.col("id")).alias("tail"))
    earlier = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("run", F.count("last").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("sum", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(*by, F.last("last", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.lag("sum").over(earlier).alias("carry"))
    t = t.join(ends, by).where("head is null")
    first = F.col("own").isNull()
    return t.select(F.when(first, F.col("carried")).otherwise(F.col("own")).alias("chr"), (F.col("before") + F.when(first, F.coalesce("carry", F.lit(0))).otherwise(0)).cast("bigint").alias("start"), "seq")


def fasta_bases(lines: DataFrame) -> DataFrame:
    """One row for each base: ``chr, pos, base`` (null for N)."""
    return lines.select("chr", "start", F.posexplode(F.split("seq", "")).alias("k", "x")).where("length(x) = 1").select("chr", (F.col("start") + F.col("k")).alias("pos"), base_code(F.col("x")).alias("base"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """Contig dictionary ``contig, length, offset, linebases, linewidth``."""
    return spark.read.csv(path, sep="\t", schema="contig string, length bigint, `offset` bigint, linebases int, linewidth int")


def sites(spark: SparkSession, path: str) -> DataFrame:
    """A site list of 2 (chr, pos), 3 (chr, start, end), 4 (with alleles) or 7 columns (with af, ac, an): ``chr, pos`` (0-based) and what there is.

    Three columns are ranges of 1-based starts and ends; each becomes its positions.
    """
    t = spark.read.text(path).where("length(trim(value)) > 0").select(_fields().alias("f"))
    f = F.col("f")
    width = t.select(F.max(F.size("f"))).first()[0] or 2
    if width == 3:
        return t.select(f[0].alias("chr"), F.explode(F.sequence(f[1].cast("int") - 1, f[2].cast("int") - 1)).alias("pos"))
    cols = [f[0].alias("chr"), (f[1].cast("int") - 1).alias("pos")]
    if width >= 4:
        cols += [base_code(f[2]).alias("major"), base_code(f[3]).alias("minor")]
    if width >= 7:
        cols += [f[4].cast("double").alias("af"), f[5].cast("double").alias("ac"), f[6].cast("double").alias("an")]
    return t.select(*cols)


def site_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, stop`` (0-based, half open) of a file of contig, start and end, as they stand: for ``in_regions``, which joins on position tiles, so
    that long ranges aren't spelled out position by position."""
    f = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), "\\s+").alias("f")).where(F.size("f") == 3)
    return f.select(F.get("f", F.lit(0)).alias("chr"), (F.get("f", F.lit(1)).cast("int") - 1).alias("start"), F.get("f", F.lit(2)).cast("int").alias("stop"))


def parse_region(text: str) -> tuple[str, int, int | None]:
    """A region ``chr``, ``chr:``, ``chr:a-``, ``chr:-b``, ``chr:a-b`` or ``chr:a`` (1-based, inclusive) as contig, 0-based start and stop (None: the end)."""
    m = REGION.match(text.strip())
    if not m or not m["chr"]:
        raise ValueError(f"no region: {text!r}")
    a, b = m["a"], m["b"]
    if not m["dash"] and a:
        return m["chr"], int(a) - 1, int(a)
    return m["chr"], int(a) - 1 if a else 0, int(b) if b else None


def regions(spark: SparkSession, path_or_list: str | list[str]) -> DataFrame:
    """Regions of a file or list: ``chr, start, stop`` (half open; the largest int where open)."""
    lines = path_or_list if isinstance(path_or_list, list) else [r["value"] for r in spark.read.text(path_or_list).collect() if r["value"].strip()]
    rows = [(c, a, b if b is not None else 2**31 - 1) for c, a, b in map(parse_region, lines)]
    return spark.createDataFrame(rows, "chr string, start int, stop int")


def file_list(lines: str, most: int | None = None) -> list[str]:
    """Paths of a list file's text, at most ``most``; carriage returns are an error."""
    if "\r" in lines:
        raise ValueError("the file list has carriage returns")
    return [x for x in lines.split("\n") if x.strip()][:most]


def hapmap(spark: SparkSession, path: str, min_maf: float = 0.05, min_distance: int = 0, drop_transitions: bool = False) -> DataFrame:
    """Allele frequencies ``pos, allele1, freq, strand, allele2``: minor ones in range, on the forward strand, the first of repeats, far enough from the next."""
    t = spark.read.text(path).where("length(trim(value)) > 0").select(_fields().alias("f"), F.monotonically_increasing_id().alias("id"))
    f = F.col("f")
    a, b = base_code(f[1]), base_code(f[4])
    flip = f[3] == "-"
    t = t.select("id", f[0].cast("int").alias("pos"), F.when(flip, 3 - a).otherwise(a).alias("allele1"), f[2].cast("double").alias("freq"), f[3].alias("strand"), F.when(flip, 3 - b).otherwise(b).alias("allele2"))
    t = t.where(F.col("freq").between(min_maf, 1 - min_maf))
    if drop_transitions:
        t = t.where(F.abs(F.col("allele1") - F.col("allele2")) != 2)
    t = t.groupBy("pos").agg(F.min_by(F.struct("allele1", "freq", "strand", "allele2"), F.col("id")).alias("r")).select("pos", "r.*")
    tile = Window.partitionBy(F.floor(F.col("pos") / 1_000_000)).orderBy("pos")
    first = t.groupBy(F.floor(F.col("pos") / 1_000_000).alias("t")).agg(F.min("pos").alias("p"))
    t = t.withColumns({"__next": F.lead("pos").over(tile), "t": F.floor(F.col("pos") / 1_000_000)})
    nxt = first.select((F.col("t") - 1).alias("t"), F.col("p").alias("__p"))
    t = t.join(nxt, "t", "left").withColumn("__next", F.coalesce("__next", "__p"))
    return t.where(F.col("__next").isNull() | (F.col("__next") - F.col("pos") >= min_distance)).select("pos", "allele1", "freq", "strand", "allele2")


def matrix(spark: SparkSession, path: str, columns: list[int] | None = None) -> DataFrame:
    """Numbers of a phenotype or covariate file, one row a sample: ``sample, v0, v1, ...``; -999 is null."""
    t = spark.read.text(path).where("length(trim(value)) > 0").select(F.monotonically_increasing_id().alias("id"), _fields().alias("f"))
    width = t.select(F.max(F.size("f"))).first()[0] or 0
    t = t.withColumn("sample", F.row_number().over(Window.orderBy("id")) - 1)  # one row a sample
    return t.select("sample", *(F.nullif(F.col("f")[i].cast("double"), F.lit(MISSING)).alias(f"v{k}") for k, i in enumerate(columns if columns is not None else range(width))))


def sample_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A ``.sample`` file: one row a sample, and the type (D, C, P or B) of each column, from the two header lines."""
    lines = [r["value"].split() for r in spark.read.text(path).collect() if r["value"].strip()]
    names, kinds = lines[0], dict(zip(lines[0], lines[1]))
    rows = [(i, *(x if kinds[n] in "0D" else (None if x in ("NA", "-999") else float(x)) for n, x in zip(names, line))) for i, line in enumerate(lines[2:])]
    schema = "sample int, " + ", ".join(f"`{n}` {'string' if kinds[n] in '0D' else 'double'}" for n in names)
    return spark.createDataFrame(rows, schema), kinds


def saf_text(spark: SparkSession, path: str) -> DataFrame:
    """Printed allele-frequency likelihoods: ``chr, pos`` (0-based) ``, saf``."""
    t = spark.read.text(path).where("length(trim(value)) > 0").select(_fields().alias("f"))
    number = lambda x: F.when(x.isin("-inf", "-Inf"), F.lit(float("-inf"))).otherwise(x.cast("double"))
    return t.select(F.col("f")[0].alias("chr"), (F.col("f")[1].cast("int") - 1).alias("pos"), F.transform(F.slice("f", F.lit(3), F.size("f") - 2), number).alias("saf"))


def spectrum_text(text: str) -> list[float]:
    """A printed spectrum: white-space separated numbers."""
    return [float(x) for x in text.split()]
