"""Readers of binary formats, decoded in Arrow batches on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.estimators import _lists
from lociforge.sources.blocks import SPLIT, first_block, fixed_records, open_file, spans, stream

# Fixed values of the published BAM format: letters of 4-bit bases and of operations.
_SEQ, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_TWO = [_SEQ[x >> 4] + _SEQ[x & 15] for x in range(256)]


def glf(spark: SparkSession, path: str, n_ind: int, width: int = 10, split: int = SPLIT) -> DataFrame:
    """Flat doubles, 10 (or 3) for each sample and site: ``site, sample, gl``, sites numbered within their file; three values stand for AA, AC and
    CC.  Records have a fixed length, so raw and block-compressed files are read in spans."""

    def decode(data: bytes, first: int) -> pa.RecordBatch:
        x = np.frombuffer(data).reshape(-1, n_ind, width)
        if width == 3:
            full = np.full((*x.shape[:2], 10), -1.7976931348623157e308)
            full[:, :, [0, 1, 4]] = x
            x = full
        m = len(x)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + m), n_ind)), pa.array(np.tile(np.arange(n_ind, dtype=np.int32), m)), _lists(x.reshape(-1, 10))], ["site", "sample", "gl"])

    return fixed_records(spark, path, 8 * n_ind * width, decode, "site bigint, sample int, gl array<double>", split)


def glf_rows(gl: DataFrame, samples: list, alleles: bool = False) -> DataFrame:
    """``chr, pos, value``: one site's bytes of such a file from likelihoods (or with ``alleles`` those of major and minor, columns l0, l1, l2)."""
    width = 3 if alleles else 10
    value = F.array(*(F.log(F.greatest(f"l{k}", F.lit(1e-300))) for k in range(3))) if alleles else F.col("gl")
    m = F.map_from_entries(F.collect_list(F.struct("sample", value.alias("v"))))
    kind = dict(gl.dtypes)["sample"]
    flat = F.array_repeat(F.lit(0.0), width)
    g = gl.groupBy("chr", "pos").agg(m.alias("m")).select("chr", "pos", F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(s).cast(kind)), flat) for s in samples))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["v"].flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], pa.array([r.tobytes() for r in x], pa.binary())], ["chr", "pos", "value"])

    t = dict(g.dtypes)
    return g.mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, value binary")


def _bam_header(portions: Iterator[tuple[int, bytes]]) -> tuple[list[str], int, int, bytes]:
    """Contig names, the offset of the portion that holds the first record, its place therein, and that portion's content from there on."""
    data, ends = b"", []

    def upto(n: int) -> None:
        nonlocal data
        while len(data) < n:
            at, more = next(portions)
            ends.append((len(data), at))
            data += more

    upto(8)
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    upto(at + 4)
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    names = []
    for _ in range(n_ref):
        upto(at + 4)
        (k,) = struct.unpack_from("<i", data, at)
        upto(at + 8 + k)
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    begin, place = max(((b, p) for b, p in ends if b <= at), default=(0, 0))
    return names, place, at - begin, data[at:]


def _is_record(data: bytes, at: int, n_ref: int) -> int | None:
    """Length of the record at this place if it can be one; None otherwise, 0 if there are too few bytes to tell."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, nref, npos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size < 1 << 28 and -1 <= ref < n_ref and -1 <= nref < n_ref and pos >= -1 and npos >= -1 and l_name >= 2 and l_seq >= 0):
        return None
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    if len(ops) == 4 * n_cigar and any(x & 15 > 8 for x in ops[::4]):
        return None
    return 4 + size


def _first_record(data: bytes, at: int, n_ref: int, chain: int = 5) -> int | None:
    """Whether records follow one upon another from this place: -1 if not, None if there are too few bytes to tell."""
    for _ in range(chain):
        n = _is_record(data, at, n_ref)
        if n is None:
            return -1
        if n == 0:
            return None
        at += n
    return 0


def _bam_record(data: bytes, at: int, names: list[str]) -> tuple:
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, nref, npos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
    p = at + 36
    name = data[p : p + l_name - 1].decode()
    p += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    packed = data[p : p + (l_seq + 1) // 2]
    p += (l_seq + 1) // 2
    seq = "".join(_TWO[x] for x in packed)[:l_seq]
    qual = "".join(chr(33 + min(q, 222)) for q in data[p : p + l_seq])
    aux = data[p + l_seq : at + 4 + size]
    return (name, flag, names[ref] if ref >= 0 else None, pos + 1, mapq, "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*", names[nref] if nref >= 0 else None, npos + 1, tlen, seq, qual, _tag(aux, b"RG"))


def _span_records(path: str, kind: str, size: int, lo: int, hi: int) -> Iterator[tuple]:
    """The records that begin in the portions of a file between two offsets: (place in the file, fields...)."""
    with open_file(path) as f:
        portions = stream(f, kind, 0, size)
        names, begin, within, data = _bam_header(portions)
        if hi <= begin and kind == "blocks":
            return
        marks = [(0, begin, within)]  # content from each place on lies in the portion at this offset, from this place in it on
        whole = kind != "blocks"
        at = 0
        if not whole and lo > begin:
            begin = first_block(f, lo, size)
            if begin >= hi:
                return
            portions, data, marks, at = stream(f, kind, begin, size), b"", [], None

        def more() -> bool:
            nonlocal data
            got = next(portions, None)
            if got is None:
                return False
            marks.append((len(data), got[0], 0))
            data += got[1]
            return True

        if at is None:  # where does a record begin?
            at, ended = 0, False
            while True:
                sure = _first_record(data, at, len(names)) if at < len(data) else None
                if sure == 0 or (sure is None and ended):
                    break
                if sure is None:
                    ended = not more()
                else:
                    at += 1
            if at >= len(data):
                return
        k = 0
        while True:
            while at + 4 > len(data) or at + 4 + struct.unpack_from("<i", data, at)[0] > len(data):
                if not more():
                    return
            while k + 1 < len(marks) and marks[k + 1][0] <= at:
                k += 1
            place, offset, inside = marks[k]
            if not whole and offset >= hi:
                return
            yield (offset << 16 | (at - place + inside) if not whole else offset + at - place + inside, *_bam_record(data, at, names))
            at += 4 + struct.unpack_from("<i", data, at)[0]
            if at > 1 << 22:  # let go of what is done
                data, marks = data[at:], [(m - at, o, i) for m, o, i in marks[k:]]
                at, k = 0, 0


def _tag(aux: bytes, wanted: bytes) -> str | None:
    """A text tag of a record's auxiliary fields."""
    sizes = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}
    at = 0
    while at + 3 <= len(aux):
        tag, kind = aux[at : at + 2], aux[at + 2]
        at += 3
        if kind in (90, 72):
            end = aux.index(b"\0", at)
            if tag == wanted:
                return aux[at:end].decode()
            at = end + 1
        elif kind == 66:
            sub, n = aux[at], struct.unpack_from("<i", aux, at + 1)[0]
            at += 5 + n * sizes[sub]
        else:
            at += sizes[kind]
    return None


def bam(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """Alignment records of BAM files: ``file, ord, qname, flag, chr, pos`` (1-based) ``, mapq, cigar, rnext, pnext, tlen, seq, qual, rg``.

    Block-compressed files are read in spans of ``split`` bytes: a task takes the blocks that begin in its span, looks for the first place from which
    records follow one upon another, and reads on to the end of the last record that begins in its blocks.  ``ord`` rises along the file (the offset of the
    block and the place in it).
    """
    names = ["file", "ord", "qname", "flag", "chr", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "rg"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span in zip(*(b[c].to_pylist() for c in ("path", "kind", "size", "lo", "hi"))):
                rows: list[tuple] = []
                if span[1] == "raw" and span[3]:
                    continue  # an uncompressed file is read as one stream
                for r in _span_records(*span):
                    rows.append((span[0], *r))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "file string, ord bigint, qname string, flag int, chr string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, rg string"
    return spans(spark, path, split).mapInArrow(run, schema)


def bgen(spark: SparkSession, path: str) -> DataFrame:
    """Genotype probabilities of BGEN 1.2 layout 2 (zlib or none): ``chr, pos`` (0-based) ``, allele1, allele2, probs`` (three a sample; null if missing)."""

    def decode(data: bytes) -> Iterator[tuple]:
        offset, _, _, n = struct.unpack_from("<IIII", data, 0)
        (head,) = struct.unpack_from("<I", data, 4)
        (flags,) = struct.unpack_from("<I", data, head)
        if (flags >> 2) & 15 != 2:
            raise ValueError("only layout 2 is supported")
        packed = flags & 3
        at = offset + 4
        while at < len(data):
            texts = []
            for width in ("<H", "<H", "<H"):
                (k,) = struct.unpack_from(width, data, at)
                texts.append(data[at + 2 : at + 2 + k].decode())
                at += 2 + k
            pos, n_alleles = struct.unpack_from("<IH", data, at)
            at += 6
            alleles = []
            for _ in range(n_alleles):
                (k,) = struct.unpack_from("<I", data, at)
                alleles.append(data[at + 4 : at + 4 + k].decode())
                at += 4 + k
            (size,) = struct.unpack_from("<I", data, at)
            body = data[at + 4 : at + 4 + size]
            at += 4 + size
            if packed == 1:
                body = zlib.decompress(body[4:])
            elif packed == 2:
                import zstandard

                body = zstandard.ZstdDecompressor().decompress(body[4:])
            if n_alleles != 2:
                continue
            (m,) = struct.unpack_from("<I", body, 0)
            ploidy = np.frombuffer(body, np.uint8, m, 8)
            bits = body[8 + m + 1]
            raw = np.frombuffer(body[8 + m + 2 :], np.uint8)
            wide = np.unpackbits(raw, bitorder="little")[: 2 * m * bits].reshape(2 * m, bits)
            p = (wide @ (1 << np.arange(bits, dtype=np.uint64))).astype(float).reshape(m, 2) / ((1 << bits) - 1)
            probs = [None if q >> 7 else [float(x), float(y), max(0.0, 1 - float(x) - float(y))] for (x, y), q in zip(p, ploidy)]
            yield texts[2], pos - 1, alleles[0], alleles[1], probs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.float64()))]
        for b in batches:
            for content in b["content"].to_pylist():
                rows = []
                for r in decode(content):
                    rows.append(r)
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["chr", "pos", "allele1", "allele2", "probs"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["chr", "pos", "allele1", "allele2", "probs"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "chr string, pos int, allele1 string, allele2 string, probs array<array<double>>")


def icounts(spark: SparkSession, path: str, min_depth: int = 0, max_depth: int = 2**31 - 1, split: int = SPLIT) -> DataFrame:
    """Records of a position and four counts (32-bit): ``pos, n_a, n_c, n_g, n_t`` within the depth limits; read in spans."""

    def decode(data: bytes, first: int) -> pa.RecordBatch:
        a = np.frombuffer(data, "<i4").reshape(-1, 5)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in range(5)], ["pos", "n_a", "n_c", "n_g", "n_t"])

    t = fixed_records(spark, path, 20, decode, "pos int, n_a int, n_c int, n_g int, n_t int", split)
    return t.where((F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")).between(min_depth, max_depth))


def icounts_rows(counts: DataFrame) -> DataFrame:
    """``chr, pos, value``: the bytes of each position's record (positions from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b["pos"]) + 1, *(np.asarray(b[c]) for c in ("n_a", "n_c", "n_g", "n_t"))], axis=1).astype("<i4")
            yield pa.RecordBatch.from_arrays([b["chr"], b["pos"], pa.array([r.tobytes() for r in x], pa.binary())], ["chr", "pos", "value"])

    t = dict(counts.dtypes)
    return counts.select("chr", "pos", "n_a", "n_c", "n_g", "n_t").mapInArrow(run, f"chr {t['chr']}, pos {t['pos']}, value binary")
