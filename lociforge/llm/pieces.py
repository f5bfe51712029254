"""Cutting oversized items at natural boundaries by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.session import cut

#: Coordinates per tile: a task sees at most so many distinct sites of one block and tile.
TILE = 1 << 16
#: A problem of the dynamic programme spans at most about so many tiles, or so many times the size limit where that is more.
PROBLEM, LIMITS = 16, 64
_PIECES = "block_id bigint, piece_start bigint, piece_stop bigint, cut string, run_start bigint, block_start bigint"


def cut_points(first: np.ndarray, last: np.ndarray, win: int) -> list[int]:
    """Where to cut consecutive stretches that each fit into ``win``: indices of the stretches that begin a piece.

    The dynamic programme over the boundaries minimises, over all ways to cut that keep every piece within ``win``, the sum of
    cut penalties (1 a cut plus up to 1 more for a narrow boundary) and of size imbalance (squared deviation, relative to
    win, from the size of pieces of equal number).
    """
    m = len(first)
    total = int(last[-1] - first[0] + 1)
    if total <= win:
        return [0]
    even = total / -(-total // win)
    gap = np.r_[np.inf, first[1:] - last[:-1]].astype(float)
    penalty = 1 + 1 / (1 + gap / max(1.0, float(np.median(gap[1:]))))
    penalty[0] = 0
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros(m + 1, dtype=np.int64)
    low = np.searchsorted(first, last - win + 1)  # the earliest stretch that a piece ending with this one may begin with
    for j in range(m):
        i = np.arange(low[j], j + 1)
        cost = best[i] + penalty[i] + ((last[j] - first[i] + 1 - even) / win) ** 2
        k = int(np.argmin(cost))
        best[j + 1], back[j + 1] = cost[k], i[k]
    cuts, j = [], m
    while j > 0:
        cuts.append(int(back[j]))
        j = int(back[j])
    return cuts[::-1]


def cut_inside(a: int, z: int, win: int, step: int) -> list[tuple[int, int]]:
    """Pieces (both ends inclusive) of a stretch from a to z that is longer than ``win``: consecutive ones overlap by exactly win - step.

    All inner places cost the same cut, so the programme's optimum is known in closed form: the fewest pieces, of sizes that differ by at
    most one.
    """
    over = win - step
    fresh = z - a + 1 - over
    n = -(-fresh // step)
    starts = [a + k * fresh // n for k in range(n + 1)]
    return [(x, y + over - 1) for x, y in zip(starts, starts[1:])]


def cut_problem(first: np.ndarray, last: np.ndarray, win: int, step: int | None) -> list[tuple[int, int, str, int | None]]:
    """Pieces ``(start, stop, cut, run_start)`` (stop inclusive) of one independent problem, given its stretches in order.

    ``cut`` is ``boundary`` for pieces of whole stretches and ``inside`` for the pieces of a stretch longer than ``win``, which
    stands alone in its problem: those carry the stretch's first position.
    """
    step = win if step is None or not 0 < step <= win else step
    if int(last[0]) - int(first[0]) + 1 > win:
        return [(x, y, "inside", int(first[0])) for x, y in cut_inside(int(first[0]), int(last[0]), win, step)]
    begins = cut_points(first, last, win)
    return [(int(first[b]), int(last[e - 1]), "boundary", None) for b, e in zip(begins, [*begins[1:], len(first)])]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for block, start, win, step, runs in zip(*(b[c].to_pylist() for c in ("block_id", "block_start", "win", "step")), b["runs"]):
            first, last = np.asarray(runs.values.field("first")), np.asarray(runs.values.field("last"))
            order = np.argsort(first, kind="stable")
            out += [(block, *p, start) for p in cut_problem(first[order], last[order], win, step)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], [x.split()[0] for x in _PIECES.split(", ")])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0), pa.int64()))


def _tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each tile's sites, as if the tile stood alone."""
    keep = ["block_id", "tile", "win", "step", "min_gap", "block_start"]
    for b in batches:
        firsts, lasts = [], []
        for posi, gap in zip(b["posi"], b["min_gap"].to_pylist()):
            x = np.sort(np.asarray(posi.values))
            cuts = np.flatnonzero(np.diff(x) > gap) + 1 if gap is not None else np.empty(0, int)
            firsts.append(x[np.r_[0, cuts].astype(int)])
            lasts.append(x[np.r_[cuts - 1, len(x) - 1].astype(int)])
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), _lists(firsts), _lists(lasts)], [*keep, "firsts", "lasts"])


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches that begin in each tile, with their whole length, and which of them begin an independent problem.

    A stretch longer than win, or a boundary too wide for any piece, separates problems; so does the widest boundary of a tile now and then,
    which bounds a problem's size.
    """
    keep = ["block_id", "tile", "win", "step", "block_start"]
    for b in batches:
        firsts, lasts, opens, latest = [], [], [], []
        cols = (b[c].to_pylist() for c in ("tile", "win", "goes_on", "comes_in", "open_start", "open_stop", "before"))
        for tile, win, goes_on, comes_in, start, stop, before, f, z in zip(*cols, b["firsts"], b["lasts"]):
            first, last = np.array(f.values), np.array(z.values)
            if goes_on:  # into later tiles
                last[-1] = stop
            prev_first, prev_last = np.r_[-1, first[:-1]], np.r_[-1, last[:-1]]
            if comes_in:  # the first stretch began in an earlier tile
                prev_first[1:2] = start
                first, last, prev_first, prev_last = first[1:], last[1:], prev_first[1:], prev_last[1:]
            elif before is not None:
                prev_first[0], prev_last[0] = start, before
            new = (last - first + 1 > win) | (prev_last < 0) | (prev_last - prev_first + 1 > win) | (first - prev_last + 1 > win)
            if len(first) and tile % max(PROBLEM, -(-LIMITS * win // TILE)) == 0:
                new[np.argmax(first - prev_last)] = True
            firsts.append(first)
            lasts.append(last)
            opens.append(np.maximum.accumulate(np.where(new, first, -1)) if len(first) else first)
            latest.append(int(first[new][-1]) if new.any() else None)
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), _lists(firsts), _lists(lasts), _lists(opens), pa.array(latest, pa.int64())], [*keep, "firsts", "lasts", "opens", "latest"])


def _sites(sites: DataFrame, tile: int) -> DataFrame:
    rows = sites.where("block_id is not null and posi is not null").select(F.col("block_id").cast("bigint").alias("block_id"), F.col("posi").cast("bigint").alias("posi"), "args_id")
    return rows.withColumn("tile", F.floor(F.col("posi") / F.lit(tile)))


def pieces(sites: DataFrame, args: DataFrame, tile: int = TILE) -> DataFrame:
    """The pieces of every block: ``block_id, piece_start, piece_stop, cut, run_start, block_start`` (both ends inclusive); no two pieces of a
    block have the same start.

    Sites with null posi or block_id are ignored, repeated deliveries count once.  A block's limits are the ``win``, ``step``
    and ``min_gap`` of its args_id (the largest, if its rows disagree); a block of an unknown args_id has no limit and stays whole, a null
    min_gap means no natural boundary.  ``step`` outside 1..win means pieces that don't overlap.  Other columns are ignored.

    No task holds a block: stretches are found per (block, tile of positions); those that cross tiles, and the independent problems of
    a block, are joined from one row a tile; and the dynamic programme gets the stretches of one problem, at most those of
    about 2 * PROBLEM tiles or 2 * LIMITS * win positions.
    """
    limit = args.where("args_id is not null").groupBy("args_id").agg(F.max(F.struct("win", "step", "min_gap")).alias("a"))
    tiles = cut(_sites(sites, tile).groupBy("block_id", "tile").agg(F.collect_set("posi").alias("posi"), F.max("args_id").alias("args_id")))
    ends = tiles.select("block_id", "tile", "args_id", F.array_min("posi").alias("a"), F.array_max("posi").alias("z"))
    blocks = ends.groupBy("block_id").agg(F.max("args_id").alias("args_id"), F.min("a").alias("block_start"), F.max("z").alias("block_stop"))
    blocks = blocks.join(limit, "args_id", "left").select("block_id", "block_start", "block_stop", *(F.col(f"a.{c}").cast("bigint").alias(c) for c in ("win", "step", "min_gap")))
    blocks = cut(blocks.withColumn("fits", F.coalesce(F.col("block_stop") - F.col("block_start") + 1 <= F.col("win"), F.lit(True))))
    whole = blocks.where("fits").select("block_id", F.col("block_start").alias("piece_start"), F.col("block_stop").alias("piece_stop"), F.lit("whole").alias("cut"), F.lit(None).cast("bigint").alias("run_start"), "block_start")

    own = ends.select("block_id", "tile").join(blocks.where("not fits").drop("block_stop", "fits"), "block_id")
    keys = "block_id bigint, tile bigint, win bigint, step bigint"
    big = tiles.select("block_id", "tile", "posi").join(own, ["block_id", "tile"]).select("block_id", "tile", "win", "step", "min_gap", "block_start", "posi")
    runs = cut(big.mapInArrow(_tile_runs, f"{keys}, min_gap bigint, block_start bigint, firsts array<bigint>, lasts array<bigint>"))

    # what a tile must know of the others: where the stretch that comes in began, and where the one that goes on ends
    by = Window.partitionBy("block_id").orderBy("tile")
    line = runs.select("block_id", "tile", "min_gap", F.size("firsts").alias("n"), F.element_at("firsts", 1).alias("a"), F.element_at("firsts", -1).alias("a2"), F.element_at("lasts", 1).alias("z1"), F.element_at("lasts", -1).alias("z"))
    line = line.withColumns({"before": F.lag("z").over(by), "after": F.lead("a").over(by)})
    one = lambda x: F.coalesce(x <= F.col("min_gap"), F.col("min_gap").isNull() & x.isNotNull())
    line = line.withColumns({"comes_in": one(F.col("a") - F.col("before")), "goes_on": one(F.col("after") - F.col("z"))})
    begun = F.when(~F.col("comes_in") | (F.col("n") > 1), F.col("a2"))
    ended = F.when(~F.col("goes_on") | (F.col("n") > 1), F.col("z1"))
    line = line.withColumns({
        "open_start": F.last(begun, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "open_stop": F.first(ended, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)),
    })
    placed = runs.drop("min_gap").join(line.select("block_id", "tile", "comes_in", "goes_on", "open_start", "open_stop", "before"), ["block_id", "tile"])
    placed = cut(placed.mapInArrow(_joined_runs, f"{keys}, block_start bigint, firsts array<bigint>, lasts array<bigint>, opens array<bigint>, latest bigint"))

    carry = placed.select("block_id", "tile", F.last("latest", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    each = placed.select("block_id", "tile", "win", "step", "block_start", F.explode(F.arrays_zip("firsts", "lasts", "opens")).alias("r"))
    each = each.join(carry, ["block_id", "tile"])
    problem = F.when(F.col("r.opens") >= 0, F.col("r.opens")).otherwise(F.col("carry"))
    lists = each.groupBy("block_id", problem.alias("problem"), "win", "step", "block_start").agg(F.collect_list(F.struct(F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"))).alias("runs"))
    return whole.unionByName(lists.select("block_id", "block_start", "win", "step", "runs").mapInArrow(_cut_rows, _PIECES))


def piece_sites(sites: DataFrame, made: DataFrame, tile: int = TILE) -> DataFrame:
    """Each site with the pieces it belongs to (two or more where pieces overlap): ``block_id, piece_start, posi``."""
    tiles = F.sequence(F.floor(F.col("piece_start") / F.lit(tile)), F.floor(F.col("piece_stop") / F.lit(tile)))
    spread = made.select("block_id", "piece_start", "piece_stop", F.explode(tiles).alias("tile"))
    once = _sites(sites, tile).select("block_id", "tile", "posi").distinct()
    return once.join(spread, ["block_id", "tile"]).where("posi between piece_start and piece_stop").select("block_id", "piece_start", "posi")


def oversized(made: DataFrame) -> DataFrame:
    """``block_id, kind, first_posi``: blocks that had to be cut (``item``) and stretches that had to be cut inside (``run``)."""
    cases = F.array(
        F.struct(F.lit("item").alias("kind"), F.col("block_start").alias("first_posi")),
        F.struct(F.lit("run").alias("kind"), F.col("run_start").alias("first_posi")),
    )
    rows = made.where("cut <> 'whole'").select("block_id", F.explode(cases).alias("c")).select("block_id", "c.*")
    return rows.where("first_posi is not null").distinct().select("block_id", "kind", F.col("first_posi").cast("int").alias("first_posi"))
