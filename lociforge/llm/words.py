"""Words of a text, hashed word features, and sums of fixed-size arrays over all partitions."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Soft hyphen and zero-width characters, which never belong to a word (fixed values).
INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e]")
_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, after removing invisible characters, NFKC and full case folding."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold())


class Buckets:
    """Stable hash of words into a fixed number of features, remembered up to a bounded number of words."""

    def __init__(self, size: int, most: int = 500_000) -> None:
        self.size, self.most, self.known = size, most, {}

    def __call__(self, ws: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in ws:
            b = known.get(w)
            if b is None:
                b = known[w] = zlib.crc32(w.encode()) % self.size
            out.append(b)
        return out


#: Tables added up by one task in each round of ``summed``, and tasks that read the input, for each core, at most.
FAN, READERS = 16, 4


def summed(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], shape: tuple[int, int], block: int = 1024) -> np.ndarray:
    """The sum over all partitions of the arrays that ``fill`` adds to; ``shape`` is fixed and must not grow with the data.

    Each task keeps one array and emits it in blocks of rows.  An input of more partitions than READERS for each core is read by fewer tasks, but at
    least a sixteenth as many, so that fewer arrays come out.  Blocks are added up in a tree: every round a task takes those of FAN
    tasks of the round before, until one array is left for the driver; the widths follow the input, no round has a fixed number of tasks.
    """
    height, width = shape
    schema = "block int, part int, data binary"
    names = ["block", "part", "data"]
    types = [pa.int32(), pa.int32(), pa.binary()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, types)], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float64)
        fill(batches, total)
        part = TaskContext.get().partitionId()
        for at in range(0, height, block):
            part_sum = total[at : at + block]
            if part_sum.any():
                yield emit([(at, part, part_sum.tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for at, part, data in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data)
                key = (at, part)
                sums[key] = sums[key] + x if key in sums else x
        for (at, part), x in sums.items():
            yield emit([(at, part, x.tobytes())])

    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, df.rdd.getNumPartitions())
    fewer = min(tasks, max(READERS * cores, -(-tasks // FAN)))
    sums = (df.coalesce(fewer) if fewer < tasks else df).mapInArrow(partial, schema)
    blocks = -(-height // block)
    while True:
        tasks, fewer = fewer, -(-fewer // FAN)
        sums = sums.select("block", F.floor(F.col("part") / FAN).cast("int").alias("part"), "data").repartition(min(blocks * fewer, max(cores, -(-blocks * fewer // 8))), "block", "part").mapInArrow(add, schema)
        if fewer == 1:
            break
    out = np.zeros(shape, np.float64)
    for at, _, data in sums.collect():
        out[at : at + block] = np.frombuffer(data).reshape(-1, width)
    return out
