"""Large binary files in spans: each task opens its file at an offset and reads the records that begin in its span.

Raw files split at any record.  Block-compressed files (members of at most 64 KB that tell their length) split at any block; other gzip files are
read by one task as a stream.  No file is held in memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a span.
SPLIT = 64 << 20
#: Fixed values of the published block format: magic of a block with a length field, and the most bytes that a block can have.
MAGIC, MOST = b"\x1f\x8b\x08\x04", 1 << 16
_SPANS = "path string, kind string, size bigint, lo bigint, hi bigint"


def open_file(path: str) -> pa.NativeFile:
    """A file for random access, on any file system that Arrow knows."""
    system, name = fs.FileSystem.from_uri(unquote(path[5:]) if path.startswith("file:/") and not path.startswith("file://") else unquote(path[7:]) if path.startswith("file:///") else path)
    return system.open_input_file(name)


def block_length(head: bytes) -> int | None:
    """Length of the block that begins with these (at least 18) bytes, None if it is none."""
    if head[:4] != MAGIC or len(head) < 18 or head[12:14] != b"BC":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def first_block(f: pa.NativeFile, at: int, size: int) -> int:
    """Offset of the first block that begins at or after ``at``; the file's size if there is none."""
    if at == 0:
        return 0
    f.seek(at)
    data = f.read(2 * MOST + 64)
    k = data.find(MAGIC)
    while 0 <= k <= MOST:
        n = block_length(data[k : k + 18])
        if n is not None and (at + k + n == size or block_length(data[k + n : k + n + 18]) is not None):
            return at + k
        k = data.find(MAGIC, k + 1)
    return size


def blocks(f: pa.NativeFile, at: int, size: int, inflate: bool = True) -> Iterator[tuple[int, bytes]]:
    """Offset and content (or, without ``inflate``, the four bytes that tell its length) of each block from ``at`` on."""
    f.seek(at)
    buffer, start = b"", at
    while at < size:
        need = at - start + MOST
        if len(buffer) < need and start + len(buffer) < size:
            buffer, start = buffer[at - start :], at
            buffer += f.read((1 << 20) + MOST)
        n = block_length(buffer[at - start : at - start + 18])
        if n is None:
            raise ValueError(f"no block at {at}")
        body = buffer[at - start : at - start + n]
        yield at, zlib.decompress(body[12 + struct.unpack_from("<H", body, 10)[0] : -8], -15) if inflate else body[-4:]
        at += n


def stream(f: pa.NativeFile, kind: str, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Content from an offset on, in portions with their offsets: raw bytes, blocks, or a whole gzip file from its beginning."""
    if kind == "blocks":
        yield from blocks(f, at, size)
    elif kind == "raw":
        f.seek(at)
        while at < size and (data := f.read(1 << 20)):
            yield at, data
            at += len(data)
    else:
        f.seek(0)
        at, z = 0, zlib.decompressobj(31)
        while data := f.read(1 << 20):
            while data:
                out = z.decompress(data)
                if out:
                    yield at, out
                    at += len(out)
                data = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)


def spans(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """``path, kind, size, lo, hi``: the spans of all files, one partition each; only names, lengths and first bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, size in zip(b["path"].to_pylist(), b["length"].to_pylist()):
                with open_file(p) as f:
                    head = f.read(18)
                kind = "raw" if head[:2] != MAGIC[:2] else "blocks" if block_length(head) else "gzip"
                lows = range(0, max(size, 1), split) if kind != "gzip" else [0]
                m = len(lows)
                yield pa.RecordBatch.from_arrays([pa.array([p] * m), pa.array([kind] * m), pa.array([size] * m, pa.int64()), pa.array(list(lows), pa.int64()), pa.array([min(x + split, size) if kind != "gzip" else size for x in lows], pa.int64())], ["path", "kind", "size", "lo", "hi"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    n = files.agg(F.sum(F.ceil(F.col("length") / split) + 1)).first()[0] or 1
    return files.mapInArrow(run, _SPANS).repartition(int(n), "path", "lo")


def fixed_records(spark: SparkSession, path: str | list[str], size: int, decode: Callable[[bytes, int], pa.RecordBatch], schema: str, split: int = SPLIT, portion: int = 4096) -> DataFrame:
    """Records of ``size`` bytes: ``decode`` turns portions of whole records and the number of their first record in the file into batches.

    A record belongs to the span it begins in.  In block-compressed files places count in uncompressed bytes, which the blocks' lengths, read in a first
    pass without inflating anything, add up to.
    """
    found = spans(spark, path, split)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = []
            for p, kind, end, lo, hi in zip(*(b[c].to_pylist() for c in ("path", "kind", "size", "lo", "hi"))):
                n = hi - lo
                if kind == "blocks":
                    n = 0
                    with open_file(p) as f:
                        for at, tail in blocks(f, first_block(f, lo, end), end, inflate=False):
                            if at >= hi:
                                break
                            n += struct.unpack("<I", tail)[0]
                total.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.int64())], [*b.schema.names, "n"])

    counted = found.mapInArrow(lengths, _SPANS + ", n bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("start", before)
    placed = placed.repartition(found.rdd.getNumPartitions(), "path", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, kind, end, lo, hi, n, start in zip(*(c.to_pylist() for c in b.columns)):
                first, last = -(-start // size), -(-(start + n) // size) if kind != "gzip" else None
                if last is not None and first >= last:
                    continue
                with open_file(p) as f:
                    at = first_block(f, lo, end) if kind == "blocks" else lo
                    skip = first * size - start
                    held, k = b"", first
                    for _, data in stream(f, kind, at, end):
                        held += data
                        if skip:
                            skip, held = max(0, skip - len(held)), held[skip:]
                        while len(held) >= portion * size or (last is not None and len(held) >= (last - k) * size > 0):
                            m = portion if last is None else min(portion, last - k)
                            yield decode(held[: m * size], k)
                            held, k = held[m * size :], k + m
                        if last is not None and k >= last:
                            break
                    if (m := len(held) // size) and (last is None or k < last):
                        m = m if last is None else min(m, last - k)
                        yield decode(held[: m * size], k)

    return placed.select("path", "kind", "size", "lo", "hi", "n", "start").mapInArrow(run, schema)


def write_binary(rows: DataFrame, folder: str, *keys: str) -> list[str]:
    """The ``value`` column (bytes) of ordered rows as files ``part-00000 ...`` of a folder that all executors share; returns their names.

    A task that is repeated writes the same file again.
    """
    from pyspark import TaskContext

    from lociforge.sources.sinks import ordered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        with system.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for v in b["value"].to_pylist():
                    out.write(v)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r[0] for r in ordered(rows, *keys).select("value").mapInArrow(run, "name string").collect())
