"""Mixing sources to target shares of the tokens by cube-method balanced sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.session import cut

#: Folder of the public tokenizers' vocabulary files, unless the setting spark.lociforge.tokenizers names another, and the file used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The published split pattern of the byte-level BPE vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Texts up to so many characters are encoded in one call.
CHARS = 10_000
#: Documents of a source that one flight takes in.
FLIGHT = 100_000
_UNITS = "doc_id bigint, source_name string, bucket int, n_tokens bigint, copies int, pi double"
_ENCODINGS: dict[int, tuple] = {}


def _encoding(vocabulary: bytes) -> tuple:
    """The tokenizer and its ranks."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = (tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks)
    return _ENCODINGS[key]


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens of one piece: neighbours whose union has the lowest rank (the first of equals) are joined until none has one."""
    n = len(piece)
    end = list(range(1, n + 1))  # a part reaches from its index to end[index]; begin[end] is its index
    begin = list(range(-1, n))
    alive = bytearray([1]) * n

    def pair(i: int) -> tuple | None:
        j = end[i]
        rank = ranks.get(piece[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, j, end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapify(heap)
    while heap:
        _, i, j, z = heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != z:
            continue
        alive[j] = 0
        end[i], begin[z] = z, i
        n -= 1
        for k in (i, begin[i] if i else -1):
            if k >= 0 and end[k] < len(piece):
                p = (ranks.get(piece[k : end[end[k]]]), k, end[k], end[end[k]])
                if p[0] is not None:
                    heappush(heap, p)
    return n


def token_length(text: str, encoding: tuple) -> int:
    """Number of tokens of a text.  The split pattern's pieces are encoded independently of each other, so a long text is encoded in
    runs of whole pieces, and a piece too long for the tokenizer by ``merged_length``: the count doesn't depend on the cuts."""
    enc, ranks = encoding
    if len(text) <= CHARS:
        return len(enc.encode_ordinary(text))
    n, start, last = 0, 0, 0
    for m in _SPLIT.finditer(text):
        a, z = m.span()
        if z - start > CHARS:
            n += len(enc.encode_ordinary(text[start:a])) if a > start else 0
            start = a
            if z - a > CHARS:
                n += merged_length(text[a:z].encode("utf-8", "replace"), ranks)
                start = z
        last = z
    return n + (len(enc.encode_ordinary(text[start:last])) if last > start else 0)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., n_tokens`` of each row; null texts have none.  The vocabulary file (under 1 MB) is read on the driver and broadcast."""
    spark = df.sparkSession
    folder = tokenizers or spark.conf.get("spark.lociforge.tokenizers", TOKENIZERS)
    shared = spark.sparkContext.broadcast(Path(folder, vocabulary).read_bytes())
    kept = df.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_tokens bigint"])
    names = [*kept.columns, "n_tokens"]
    n_keep = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        for b in batches:
            n = [token_length(t, encoding) if t else 0 for t in b.column(n_keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(n, pa.int64())], names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


class Flight:
    """The flight phase for one source: moves inclusion probabilities along the null space of the balancing equations.

    Kept equal are the expected number of documents and of tokens.  Three undecided documents span a null space of at least one
    dimension; a random step along it, in either direction with the probabilities that keep each expectation, decides at least
    one of them.  So at most two stay undecided, however many documents stream through.
    """

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.held: list[list] = []  # [row, tokens, probability]

    def add(self, row: tuple, tokens: int, pi: float) -> list[tuple[tuple, int]]:
        """Takes one document in; returns (row, 0 or 1) of those that are decided by it."""
        self.held.append([row, tokens, pi])
        out = []
        while len(self.held) >= 3:
            a, b, c = self.held
            u = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = down = float("inf")
            for x, h in zip(u, self.held):
                if x > 0:
                    up, down = min(up, (1 - h[2]) / x), min(down, h[2] / x)
                elif x < 0:
                    up, down = min(up, h[2] / -x), min(down, (1 - h[2]) / -x)
            step = up if self.rng.random() * (up + down) < down else -down
            keep = []
            for x, h in zip(u, self.held):
                h[2] += step * x
                if h[2] < 1e-9 or h[2] > 1 - 1e-9:
                    out.append((h[0], int(h[2] > 0.5)))
                else:
                    keep.append(h)
            self.held = keep
        return out

    def land(self) -> list[tuple[tuple, int]]:
        """Decides the last documents, keeping the expected number of documents as nearly as whole numbers can."""
        total = sum(h[2] for h in self.held)
        n = int(total) + int(self.rng.random() < total - int(total))
        if len(self.held) == 2 and n == 1:
            # one of the two: each with its share of the probability of standing alone
            a, b = (h[2] * (1 - o[2]) for h, o in zip(self.held, self.held[::-1]))
            first = int(self.rng.random() * (a + b) < a)
            return [(self.held[0][0], first), (self.held[1][0], 1 - first)]
        return [(h[0], int(n == len(self.held))) for h in self.held]


def _flights(batches: Iterator[pa.RecordBatch], seed: int, land: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by source and bucket (for the landing, by source): decided documents come out with copies, the at most two left of
    each with their pi.  The draws depend on seed, source and bucket alone."""
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
    names = [x.split()[0] for x in _UNITS.split(", ")]
    key, flight = None, None
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        rows = out[:]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names)

    def close() -> None:
        if flight and land:
            out.extend((*r[:4], r[4] + s, None) for r, s in flight.land())
        elif flight:
            out.extend((*h[0], h[2]) for h in flight.held)

    for b in batches:
        for doc, source, bucket, tokens, copies, pi in zip(*(c.to_pylist() for c in b.columns)):
            row = (doc, source, bucket, tokens, copies)
            if pi is None or pi <= 0:
                out.append((*row, None))
                continue
            now = (source, 0 if land else bucket)
            if now != key:
                close()
                key, flight = now, Flight(np.random.default_rng([seed, int(land), now[1], *source.encode()]))
            out += [(*r[:4], r[4] + s, None) for r, s in flight.add(row, tokens, pi)]
        yield emit()
    close()
    yield emit()


def _targets(targets: DataFrame) -> DataFrame:
    wanted = F.struct(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    name = F.lower(F.trim("source_name"))
    return targets.where("source_name is not null").groupBy(name.alias("source_name")).agg(F.max(wanted).alias("w")).select("source_name", "w.*")


def mix(docs: DataFrame, targets: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: ``doc_id, source_name, n_tokens, copies`` of every document of a target source, copies from 0 to max_repeats.  Report:
    ``source_name, n_docs, size, target_share, max_repeats, target_tokens, falls_short, used_docs, actual_tokens, actual_share``
    for every target, also for one without documents.  A source's target is its share of the total size of all target sources;
    a source falls short if even max_repeats of all its documents don't reach it, and is then used so often throughout.

    Each document gets the whole part of target / size copies; the fraction left is its inclusion probability for one more, and
    the cube method decides it so that the number of documents and of tokens of the source is kept.  Sources are balanced one by one.  A source's
    documents are dealt by a hash of their ids into buckets of about FLIGHT, the flight phase streams through each and leaves
    at most two documents; these fly once more per source, and at most two remain for the landing, so a source that can reach its
    target misses it by less than two of its longest documents.  Draws depend on ids, names and the seed only, not on partitions.

    Source names are compared trimmed and in lower case; documents of null or other sources don't count; null and blank texts have
    their few or no tokens; texts delivered twice count twice; a null share is 0, null max_repeats 1; repeated targets count once
    (the larger); other columns are ignored; without documents the mixture is empty.
    """
    wanted = _targets(targets)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source_name"), "text").join(wanted.select("source_name"), "source_name", "left_semi")
    units = cut(count_tokens(named, ["doc_id", "source_name"], "text", tokenizers, vocabulary))
    sizes = units.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size"))
    plan = wanted.join(sizes, "source_name", "left").fillna(0, ["n_docs", "size"])
    plan = plan.withColumn("target_tokens", F.col("target_share") * F.sum("size").over(Window.partitionBy(F.lit(0))))  # one row a target
    ratio = F.least(F.coalesce(F.col("target_tokens") / F.when(F.col("size") > 0, F.col("size")), F.lit(0.0)), F.col("max_repeats").cast("double"))
    plan = cut(plan.withColumn("__ratio", ratio))
    rows = units.join(plan.select("source_name", "__ratio", "n_docs"), "source_name")
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_docs") / FLIGHT)).cast("int")
    rows = rows.select("doc_id", "source_name", bucket.alias("bucket"), "n_tokens", F.floor("__ratio").cast("int").alias("copies"), (F.col("__ratio") - F.floor("__ratio")).alias("pi"))
    rows = rows.repartition("source_name", "bucket").sortWithinPartitions("source_name", "bucket", "doc_id", "n_tokens")
    flown = cut(rows.mapInArrow(lambda x: _flights(x, seed, False), _UNITS))
    left = flown.where("pi is not null").repartition("source_name").sortWithinPartitions("source_name", "bucket", "doc_id", "n_tokens")
    landed = left.mapInArrow(lambda x: _flights(x, seed, True), _UNITS)
    mixture = cut(flown.where("pi is null").unionByName(landed).drop("pi", "bucket"))
    used = mixture.groupBy("source_name").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.sum((F.col("copies") > 0).cast("int")).alias("used_docs"))
    report = plan.drop("__ratio").join(used, "source_name", "left").fillna(0, ["actual_tokens", "used_docs"])
    # short is what the mixture itself shows: every document as often as allowed, and the target not reached
    short = (F.col("actual_tokens") == F.col("max_repeats") * F.col("size")) & (F.col("actual_tokens") < F.col("target_tokens"))
    report = report.withColumn("falls_short", short)
    whole = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))
    return mixture, report.withColumn("actual_share", F.col("actual_tokens") / F.when(whole > 0, whole))
