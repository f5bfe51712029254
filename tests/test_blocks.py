import gzip
import struct
import zlib
from random import Random

import numpy as np
import pytest

from lociforge.sources import binary, blocks


def bgzf(data, rng, most=3000):
    """Blocks of random lengths, with the empty one at the end."""
    out, at = [], 0
    while at < len(data):
        part = data[at : at + rng.randrange(1, most)]
        at += len(part)
        out.append(part)
    packed = b""
    for part in [*out, b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        packed += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return packed


def bam_bytes(rng, n):
    refs = [b"chr1", b"chr2"]
    data = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n " + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r) + 1) + r + b"\0" + struct.pack("<i", 10**6) for r in refs)
    for k in range(n):
        name, l = f"read{k}".encode() + b"\0", rng.randrange(0, 400 if k % 50 else 9000)
        ops = struct.pack("<I", l << 4) if l else b""
        seq, qual = bytes(rng.randrange(256) for _ in range((l + 1) // 2)), bytes(rng.randrange(40) for _ in range(l))
        ref = rng.choice([-1, 0, 1])
        body = struct.pack("<iiBBHHHiiii", ref, rng.randrange(10**6), len(name), 60, 0, len(ops) // 4, 16, l, -1, -1, 0) + name + ops + seq + qual + b"NMC\x01RGZgrp\0"
        data += struct.pack("<i", len(body)) + body
    return data


def test_alignments_do_not_depend_on_spans(spark, tmp_path):
    rng = Random(3)
    data = bam_bytes(rng, 400)
    (tmp_path / "a.bam").write_bytes(bgzf(data, rng))
    (tmp_path / "b.bam").write_bytes(gzip.compress(data[:5000]) + gzip.compress(data[5000:]))
    (tmp_path / "c.bam").write_bytes(data)
    whole = binary.bam(spark, str(tmp_path / "a.bam")).drop("file").orderBy("ord").collect()
    assert [r["qname"] for r in whole] == [f"read{k}" for k in range(400)]
    split = binary.bam(spark, str(tmp_path / "a.bam"), 7000)
    assert split.rdd.getNumPartitions() > 5 and split.drop("file").orderBy("ord").collect() == whole
    want = binary.bam(spark, str(tmp_path / "a.bam")).drop("file", "ord")
    for name in ("b.bam", "c.bam"):
        got = binary.bam(spark, str(tmp_path / name), 20_000).drop("file", "ord")
        assert got.count() == 400 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("pack", ["raw", "blocks", "gzip"])
def test_records_do_not_depend_on_spans(spark, tmp_path, pack):
    rng = Random(5)
    x = np.arange(700 * 2 * 10, dtype=float)
    data = x.tobytes()
    (tmp_path / "x.glf").write_bytes({"raw": lambda d: d, "blocks": lambda d: bgzf(d, rng), "gzip": gzip.compress}[pack](data))
    for split in (blocks.SPLIT, 4001):
        got = binary.glf(spark, str(tmp_path / "x.glf"), 2, split=split).orderBy("site", "sample").collect()
        assert [(r["site"], r["sample"]) for r in got] == [(k, s) for k in range(700) for s in range(2)]
        assert np.array_equal(np.array([r["gl"] for r in got]).ravel(), x)


def test_binary_round_trips(spark, tmp_path):
    rows = [("1", p, p % 3, 1, 2, p) for p in range(500)]
    counts = spark.createDataFrame(rows, "chr string, pos int, n_a int, n_c int, n_g int, n_t int")
    out = str(tmp_path / "counts")
    assert blocks.write_binary(binary.icounts_rows(counts), out)
    got = sorted(tuple(r) for r in binary.icounts(spark, out, split=999).collect())
    assert got == [(p + 1, a, c, g, t) for _, p, a, c, g, t in rows]
    gl = spark.createDataFrame([("1", p, s, [float(-k * s) for k in range(10)]) for p in range(30) for s in range(2)], "chr string, pos int, sample int, gl array<double>")
    out = str(tmp_path / "gl")
    blocks.write_binary(binary.glf_rows(gl.coalesce(1), [0, 1]), out, "chr", "pos")
    back = binary.glf(spark, out, 2)
    assert back.count() == 60 and {tuple(r["gl"]) for r in back.collect()} == {tuple(float(-k * s) for k in range(10)) for s in range(2)}
