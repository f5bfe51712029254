"""One door to all readers: the format of a path by its name, or as given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociforge.sources import binary, tables, text

#: Format -> reader (session, path, options).
READERS: dict[str, Callable[..., DataFrame]] = {
    "bam": binary.bam, "sam": text.sam, "beagle": text.beagle, "glf": binary.glf, "glf10_text": text.glf_text, "vcf": text.vcf, "bgen": binary.bgen, "mpileup": text.mpileup, "fasta": text.fasta, "fai": text.fai,
    "sites": text.sites, "icounts": binary.icounts, "hapmap": text.hapmap, "saf_text": text.saf_text, "thetas": tables.read_thetas, "fst": tables.read_fixation, "psmc": tables.read_psmc, "haplo": tables.read_haploid,
    "parquet": lambda spark, path: spark.read.parquet(path),
}
#: Endings of file names, beside the formats' own names.
ENDINGS = {"fa": "fasta", "fna": "fasta", "gprobs": "beagle", "pileup": "mpileup", "icnts": "icounts"}


def format_of(path: str) -> str:
    """The format that a path's ending names; compression endings don't count."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    while len(parts) > 1 and parts[-1] in ("gz", "bgz", "bz2", "zst"):
        parts.pop()
    for end in reversed(parts[1:]):
        if (kind := ENDINGS.get(end, end)) in READERS:
            return kind
    raise ValueError(f"no format is known for {path}; name one of {sorted(READERS)}")


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """The table of a file or folder, by the reader of its format."""
    if kind is not None and kind not in READERS:
        raise ValueError(f"{kind} isn't one of {sorted(READERS)}")
    return READERS[kind or format_of(path)](spark, path, **options)
