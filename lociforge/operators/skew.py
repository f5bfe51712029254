"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STATE = "pool_id bigint, ref_id int, pos bigint, n_reads bigint, n_starts bigint, top_reads bigint, top_pos bigint"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one range of the (pool, ref, pos, read) order.

    The rows come sorted.  Repeated deliveries of a read are neighbours and count once.  Each (pool, ref) of the range gives
    one row for its inner positions (``pos`` null) and one for its first and for its last position, which may go on in the
    neighbouring range.
    """
    tail: np.ndarray | None = None  # the last row of the batch before, so that a repeated delivery across batches is seen
    run: list | None = None  # [pool, ref, pos, reads] of the position being counted
    key: tuple | None = None
    state: dict = {}
    out: list[tuple] = []

    def close_run() -> None:
        if run is None:
            return
        if state["first"] is None:
            state["first"] = (run[2], run[3])
            return
        if state["last"] is not None:
            add(np.array([state["last"][0]]), np.array([state["last"][1]]))
        state["last"] = (run[2], run[3])

    def add(pos: np.ndarray, n: np.ndarray) -> None:
        if not len(pos):
            return
        state["n"] += int(n.sum())
        state["k"] += len(pos)
        i = int(np.argmax(n))
        if int(n[i]) > state["top"][0]:
            state["top"] = (int(n[i]), int(pos[i]))

    def close_key() -> None:
        if key is None:
            return
        out.append((*key, None, state["n"], state["k"], state["top"][0], state["top"][1]))
        for x in (state["first"], state["last"]):
            if x is not None:
                out.append((*key, x[0], x[1], 1, x[1], x[0]))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["pool_id", "ref_id", "pos", "n_reads", "n_starts", "top_reads", "top_pos"])
        out.clear()
        return done

    for b in batches:
        if not b.num_rows:
            continue
        a = np.column_stack([np.asarray(c.cast(pa.int64())) for c in b.columns[:4]])
        named = np.asarray(b.column(4))
        with_tail = a if tail is None else np.vstack([tail, a])
        new = np.ones(len(with_tail), bool)
        new[1:] = (with_tail[1:] != with_tail[:-1]).any(1)
        new = (new if tail is None else new[1:]) | ~named
        tail = a[-1:]
        a = a[new]
        if not len(a):
            continue
        starts = np.flatnonzero(np.r_[True, (a[1:, :3] != a[:-1, :3]).any(1)])
        counts = np.diff(np.r_[starts, len(a)])
        runs = a[starts, :3]
        cuts = np.flatnonzero(np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(runs)]):
            k = (int(runs[lo, 0]), int(runs[lo, 1]))
            if k != key:
                close_run()
                close_key()
                key, run, state = k, None, {"first": None, "last": None, "n": 0, "k": 0, "top": (0, None)}
            i = lo
            if run is not None and run[2] == runs[lo, 2]:
                run[3] += int(counts[lo])
                i += 1
            if i < hi:
                close_run()
                inner_from, inner_to = i, hi - 1  # the last run of the batch stays open
                if state["first"] is None and inner_from < inner_to:
                    state["first"] = (int(runs[i, 2]), int(counts[i]))
                    inner_from += 1
                if inner_from < inner_to:
                    if state["last"] is not None:
                        add(np.array([state["last"][0]]), np.array([state["last"][1]]))
                    add(runs[inner_from : inner_to - 1, 2], counts[inner_from : inner_to - 1])
                    state["last"] = (int(runs[inner_to - 1, 2]), int(counts[inner_to - 1]))
                run = [*k, int(runs[hi - 1, 2]), int(counts[hi - 1])]
        if len(out) > 10_000:
            yield flush()
    close_run()
    close_key()
    yield flush()


def reads_per_contig(reads: DataFrame) -> DataFrame:
    """One row for each pool and contig with mapped reads: ``pool_id, ref_id, n_reads, n_starts, first_start, last_start,
    top_start, top_reads, pool_reads``.

    ``n_starts`` counts distinct start positions, ``top_start`` is the position where most reads start (the lowest of several)
    and ``pool_reads`` are the mapped reads of the pool.  Reads are unmapped when flag 4 is set or ref_id or pos is missing or
    negative; they count nowhere.  A read delivered again counts once (same pool, contig, position and read_id); reads without a
    read_id cannot be recognised and all count.  Rows without a pool_id are dropped.  Other columns are ignored; an empty input
    gives an empty result.

    The rows are range-partitioned on (pool, contig, position, read) with sampled quantiles, so a heavy contig, and even a
    single pile-up, is cut over as many partitions as its rows need; no key is ever gathered.  Each range reduces to a few
    partial states per key, and the states of positions at range ends are stitched by two small aggregations.
    """
    mapped = reads.where("pool_id is not null and ref_id >= 0 and pos is not null and (flag is null or flag & 4 = 0)")
    rows = mapped.select(
        F.col("pool_id").cast("bigint"), F.col("ref_id").cast("bigint"), F.col("pos").cast("bigint"),
        F.coalesce("read_id", F.lit(-1)).cast("bigint").alias("read_id"), F.col("read_id").isNotNull().alias("named"),
    )
    order = ["pool_id", "ref_id", "pos", "read_id", "named"]
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_states, _STATE)
    at = states.groupBy("pool_id", "ref_id", "pos").agg(
        F.sum("n_reads").alias("n_reads"), F.sum("n_starts").alias("k"),
        F.max(F.struct(F.col("top_reads"), (-F.col("top_pos")).alias("neg"))).alias("top"),
    )
    one = F.col("pos").isNotNull()  # a stitched position: its states add up to one start with all their reads
    at = at.select("pool_id", "ref_id", "pos", "n_reads", F.when(one, 1).otherwise(F.col("k")).alias("k"),
                   F.when(one, F.struct(F.col("n_reads").alias("top_reads"), (-F.col("pos")).alias("neg"))).otherwise(F.col("top")).alias("top"))
    by_key = at.groupBy("pool_id", "ref_id").agg(
        F.sum("n_reads").alias("n_reads"), F.sum("k").alias("n_starts"), F.min("pos").alias("first_start"),
        F.max("pos").alias("last_start"), F.max("top").alias("top"),
    )
    pool = F.sum("n_reads").over(Window.partitionBy("pool_id"))
    return by_key.select("pool_id", "ref_id", "n_reads", "n_starts", "first_start", "last_start",
                         (-F.col("top.neg")).alias("top_start"), F.col("top.top_reads").alias("top_reads"), pool.alias("pool_reads"))


def dominant_contigs(reads: DataFrame, share: float = 0.25) -> DataFrame:
    """``pool_id, ref_id`` of the contigs with at least ``share`` of their pool's mapped reads; see ``reads_per_contig``."""
    return reads_per_contig(reads).where(F.col("n_reads") >= F.lit(share) * F.col("pool_reads")).select("pool_id", "ref_id")
