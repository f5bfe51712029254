"""Density clusters of genotype-probability records, with their medoids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.session import cut

#: Two records are alike up to this distance.
RADIUS = 0.18
#: A panel with more records than this is cut into slices of a reduced vector, and a slice with more into blocks of about so many.
CELL = 4096
#: Up to so many large panels their slices (a few numbers each) are broadcast.
MANY_PANELS = 100_000
#: Rows of a cell compared with all others at a time.
BLOCK = 512
#: Most records of a cell, all of which are held: blocks have at most half of it.
HELD = 32768
#: Probabilities are compared as multiples of 1 / SCALE, and the radius is widened by twice the rounding.
SCALE, SLACK = 60000, 2e-5
#: A cluster of up to so many records is compared within itself; a larger one is read in portions of about so many, PARTS of them side by side.
WHOLE, PARTS = 1024, 4
#: Of a larger cluster, so many members with the smallest lower bounds of their mean distance are compared with all first.
FIRST = 64
#: Bins of the histograms behind the bounds, and the most individuals for which counts of pairs of individuals sharpen them.
BINS, PAIRED = 32, 512
_CELL = "panel_id int, nind int, cell bigint, rec_id bigint, vec binary"
_LOCAL = "rec_id bigint, local_id bigint"
_RANKED = "cluster_id bigint, size bigint, medoid_rank int, rec_id bigint, mean_distance double"


def triples(genos: np.ndarray, nind: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled triples (records x individuals x 3, zero without information) and the information mask."""
    g = genos.reshape(len(genos), nind, 3)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = g.sum(axis=2)
        info = np.isfinite(s) & (s > 0) & (g >= 0).all(axis=2) & ~((g[:, :, 0] == g[:, :, 1]) & (g[:, :, 1] == g[:, :, 2]))
        return np.where(info[:, :, None], g / s[:, :, None], 0.0), info


def block_of(rec: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each record of a panel, by a hash of its id: a record delivered again lies in the same block."""
    h = rec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)


def _pack(t: np.ndarray, info: np.ndarray) -> np.ndarray:
    """uint16 image: two probabilities of each individual, all ones where there is no information."""
    q = np.rint(t[:, :, :2] * SCALE).astype(np.uint16)
    q[~info] = 0xFFFF
    return q


def _unpack(raw: list[bytes], nind: int) -> tuple[np.ndarray, np.ndarray]:
    q = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), nind, 2)
    info = q[:, :, 0] != 0xFFFF
    t = np.zeros((len(raw), nind, 3), np.float32)
    t[:, :, :2] = q / np.float32(SCALE)
    t[:, :, 2] = np.maximum(1 - t[:, :, 0] - t[:, :, 1], 0)
    t[~info] = 0
    return t, info


def alike(t: np.ndarray, info: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in rows, positions in cols) within the radius.

    A matrix product gives the squared distance over the individuals that both have; as the distance of two triples bounds
    it (squared distance <= 2 d^2 <= 2 d), pairs beyond it need no exact look.  The rest is computed exactly.
    """
    n = t.shape[1]
    a, b, ma, mb = t[rows], t[cols], info[rows].astype(np.float32), info[cols].astype(np.float32)
    left = np.hstack([-2 * a.reshape(len(a), -1), (a * a).sum(axis=2), ma])
    right = np.hstack([b.reshape(len(b), -1), mb, (b * b).sum(axis=2)])
    both = ma @ mb.T
    i, j = np.nonzero((left @ right.T <= (2 * radius + 1e-4) * both) & (both > 0))
    keep = []
    for lo in range(0, len(i), max(1, 4_000_000 // (3 * n))):
        x, y = i[lo : lo + max(1, 4_000_000 // (3 * n))], j[lo : lo + max(1, 4_000_000 // (3 * n))]
        m = ma[x] * mb[y]
        d = 0.5 * (np.abs(a[x] - b[y]).sum(axis=2, dtype=np.float64) * m).sum(axis=1)
        keep.append(d <= (radius + SLACK) * m.sum(axis=1))
    k = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[k], j[k]


def cluster_cell(t: np.ndarray, info: np.ndarray, radius: float = RADIUS) -> np.ndarray:
    """Connected components of likeness in one cell: the component number of each record, -1 for records alike to none.

    Blocks of rows are compared with the records not yet compared.  Rows are taken a component at a time, and pairs
    already in one component aren't compared again, so a cell full of near copies costs little more than one block.
    """
    n = len(t)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    waiting = np.ones(n, bool)
    linked = np.zeros(n, bool)
    comp = parent.copy()
    while waiting.any():
        todo = np.flatnonzero(waiting)
        seed = comp[todo[0]]
        own = todo[comp[todo] == seed]
        if len(own) >= 64:  # a component of its own: only others are of interest
            rows = own[:BLOCK]
            cols = todo[comp[todo] != seed]
        else:
            rows, cols = todo[:BLOCK], todo
        waiting[rows] = False
        if not len(cols):
            continue
        i, j = alike(t, info, rows, cols, radius)
        x, y = rows[i], cols[j]
        other = x != y
        x, y = x[other], y[other]
        linked[x] = linked[y] = True
        pairs = np.unique(np.stack([comp[x], comp[y]], axis=1), axis=0) if len(x) else ()
        for p, q in pairs:
            p, q = find(int(p)), find(int(q))
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(x):
            comp = np.array([find(int(c)) for c in range(n)]) if n < 2048 else _roots(parent)
    return np.where(linked, comp, -1)


def _roots(parent: np.ndarray) -> np.ndarray:
    up = parent
    while not np.array_equal(nxt := up[up], up):
        up = nxt
    parent[:] = up
    return up.copy()


def _cluster_partition(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the records of one cell are held, all of them until the last: a later one may be alike to any."""

    def done(nind: int, held: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        ids = np.array(list(held))
        comp = cluster_cell(*_unpack(list(held.values()), nind), radius)
        ids, comp = ids[comp >= 0], comp[comp >= 0]
        if len(ids):
            order = np.lexsort((ids, comp))
            first = np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0])
            local = np.repeat(ids[order][first], np.diff(np.r_[first, len(order)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order], pa.int64()), pa.array(local, pa.int64())], ["rec_id", "local_id"])

    key, held = None, {}
    for b in batches:
        for panel, nind, cell, rec, vec in zip(*(c.to_pylist() for c in b.columns)):
            if (panel, nind, cell) != key:
                if key:
                    yield from done(key[1], held)
                key, held = (panel, nind, cell), {}
            held.setdefault(rec, vec)
    if key:
        yield from done(key[1], held)


def _usable(records: DataFrame) -> DataFrame:
    usable = "panel_id is not null and rec_id is not null and nind > 0 and genos is not null and size(genos) = 3 * nind"
    return records.where(usable).select(F.col("panel_id").cast("int"), F.col("nind").cast("int"), F.col("rec_id").cast("bigint"), "genos")


def _values(genos: pa.Array, at: np.ndarray, nind: int) -> tuple[np.ndarray, np.ndarray]:
    """``triples`` of the rows ``at`` of a column of genotype probabilities."""
    flat = genos.take(pa.array(at)).flatten()
    return triples(np.asarray(flat.fill_null(math.nan), dtype=np.float64).reshape(len(at), 3 * nind), nind)


def _groups(*cols: pa.Array) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of each combination of values."""
    keys = np.stack([np.asarray(c) for c in cols], axis=1)
    values, number = np.unique(keys, axis=0, return_inverse=True)
    for k, v in enumerate(values.tolist()):
        yield tuple(v), np.flatnonzero(number.ravel() == k)


def reach(t: np.ndarray, info: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The reduced vector of each record with its margins: lowest and highest whole number (records x 3) that it reaches.

    The k-th coordinate is the summed distance of a record's triples from the k-th pure genotype.  Let two alike records lend each other what
    one of them lacks: their coordinates then differ by at most radius * individuals, and each lies between the sum over the own
    individuals and that sum plus the missing ones.  So the intervals, widened by half that bound, of alike records overlap.
    """
    n = t.shape[1]
    own = ((1 - t) * info[:, :, None]).sum(axis=1)
    missing = n - info.sum(axis=1)[:, None]
    margin = n * (radius + 2 * SLACK) / 2 + 1e-6
    return np.floor(own - margin).astype(np.int64), np.floor(own + missing + margin).astype(np.int64)


def choose_slices(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Edges between slices of one coordinate, and the pairs to compare: as many slices, cut at quantiles, as need the fewest.

    A record stands in all slices that its interval meets, so where intervals are wide against their spread one slice is best.
    """
    total = float(n.sum())
    best, cost = np.empty(0, np.int64), total**2
    order = np.argsort(low + high, kind="stable")
    middle, share = (low + high)[order] / 2, np.cumsum(n[order]) / total
    for k in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64):
        at = np.minimum(np.searchsorted(share, np.arange(1, k) / k), len(middle) - 1)
        edges = np.unique(np.ceil(middle[at]).astype(np.int64))
        first, last = np.searchsorted(edges, low, "right"), np.searchsorted(edges, high, "right")
        held = np.zeros(len(edges) + 2)
        np.add.at(held, first, n)
        np.add.at(held, last + 1, -n)
        now = float((np.cumsum(held)[:-1] ** 2).sum())
        if now < cost:
            best, cost = edges, now
    return best, cost


def _slicing(rows: DataFrame, large: DataFrame, radius: float, cell: int) -> DataFrame:
    """``panel_id, nind, axis, edges, blocks`` of the large panels: the coordinate whose slices need the fewest comparisons, the edges between its
    slices, and the number of blocks of each slice.  The choice is made from counts of equal intervals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (p, n), at in _groups(b["panel_id"], b["nind"]):
                t, info = _values(b["genos"], at, n)
                some = info.any(axis=1)
                low, high = reach(t[some], info[some], radius)
                for axis in range(3):
                    kinds, many = np.unique(np.stack([low[:, axis], high[:, axis]], axis=1), axis=0, return_counts=True)
                    m = len(kinds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, x, np.int32)) for x in (p, n, axis)] + [pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(many.astype(np.int64))],
                        ["panel_id", "nind", "axis", "low", "high", "n"],
                    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for axis, part in pdf.groupby("axis"):
            low, high, n = (part[c].to_numpy() for c in ("low", "high", "n"))
            edges, cost = choose_slices(low, high, n)
            first, last = np.searchsorted(edges, low, "right"), np.searchsorted(edges, high, "right")
            held = np.array([n[(first <= k) & (last >= k)].sum() for k in range(len(edges) + 1)])
            found.append((cost, int(axis), edges.tolist(), np.maximum(1, -(-held // cell)).tolist()))
        _, axis, edges, blocks = min(found)
        return pd.DataFrame({"panel_id": pdf["panel_id"].iloc[:1], "nind": pdf["nind"].iloc[:1], "axis": [axis], "edges": [edges], "blocks": [blocks]})

    kinds = rows.join(large, ["panel_id", "nind"]).select("panel_id", "nind", "genos").mapInArrow(count, "panel_id int, nind int, axis int, low bigint, high bigint, n bigint")
    kinds = kinds.groupBy("panel_id", "nind", "axis", "low", "high").agg(F.sum("n").alias("n"))
    return kinds.groupBy("panel_id", "nind").applyInPandas(choose, "panel_id int, nind int, axis int, edges array<bigint>, blocks array<int>")


def local_clusters(records: DataFrame, radius: float = RADIUS, cell: int = CELL) -> DataFrame:
    """``rec_id, local_id``: the clusters found in each cell, named by their smallest record.

    A panel of up to ``cell`` records is one cell.  The reduced vectors of a larger one are cut into slices with overlapping margins, so wide that
    any two alike records share a slice; a slice that still holds more is cut into blocks, and each pair of its blocks is a cell.
    """
    cell = min(cell, HELD // 2)
    rows = _usable(records)
    sizes = rows.groupBy("panel_id", "nind").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > cell).select("panel_id", "nind"))
    many = large.limit(MANY_PANELS + 1).count()
    if many:
        slices = cut(_slicing(rows, F.broadcast(large) if many <= MANY_PANELS else large, radius, cell))
        rows = rows.join(F.broadcast(slices) if many <= MANY_PANELS else slices, ["panel_id", "nind"], "left")
    else:
        rows = rows.withColumns({"axis": F.lit(None).cast("int"), "edges": F.lit(None).cast("array<bigint>"), "blocks": F.lit(None).cast("array<int>")})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, genos = np.asarray(b["rec_id"]), b["genos"]
            for (p, n), at in _groups(b["panel_id"], b["nind"]):
                t, info = _values(genos, at, n)
                some = info.any(axis=1)  # a record that tells nothing is alike to none
                if not some.any():
                    continue
                at, t, info = at[some], t[some], info[some]
                rec, vec = ids[at], pa.array([v.tobytes() for v in _pack(t, info)], pa.binary())
                axis, edges, blocks = (b[c][int(at[0])].as_py() for c in ("axis", "edges", "blocks"))
                places = []
                if axis is None:
                    places.append((0, np.arange(len(at))))
                else:
                    low, high = reach(t, info, radius)
                    first, last = np.searchsorted(edges, low[:, axis], "right"), np.searchsorted(edges, high[:, axis], "right")
                    for k, m in enumerate(blocks):
                        inside = np.flatnonzero((first <= k) & (last >= k))
                        own = block_of(rec[inside], m)
                        for other in range(m):
                            there = inside[(own != other) | (m == 1)]
                            mine = own[(own != other) | (m == 1)]
                            for pair in np.unique(mine):
                                places.append(((k << 40) + int(min(pair, other)) * m + int(max(pair, other)), there[mine == pair]))
                for number, k in places:
                    if len(k):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), p, np.int32)), pa.array(np.full(len(k), n, np.int32)), pa.array(np.full(len(k), number, np.int64)), pa.array(rec[k], pa.int64()), vec.take(pa.array(k))],
                            ["panel_id", "nind", "cell", "rec_id", "vec"],
                        )

    by = ["panel_id", "nind", "cell"]
    placed = rows.select("panel_id", "nind", "axis", "edges", "blocks", "rec_id", "genos").mapInArrow(place, _CELL)
    return placed.repartition(*by).sortWithinPartitions(*by, "rec_id").mapInArrow(lambda x: _cluster_partition(x, radius), _LOCAL)


def merge_local(local: DataFrame) -> DataFrame:
    """``rec_id, cluster_id``: local clusters that share a record are one; cluster_id is the smallest rec_id joined.

    Where every record lies in one local cluster that is all.  Otherwise the links from records to the names of their local clusters are
    contracted by alternating large and small stars, whose number grows with the logarithm of the longest chain, not with its
    length; a cluster with a third of all records is never gathered, and each round is written to the shared checkpoint folder.
    """
    own = cut(local.groupBy("rec_id").agg(F.min("local_id").alias("cluster_id"), F.max("local_id").alias("__last")))
    if own.where("cluster_id <> __last").limit(1).count() == 0:
        return own.select("rec_id", "cluster_id")
    links = cut(local.select(F.col("rec_id").alias("a"), F.col("local_id").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # large star
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        kept = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(kept.unionByName(least.select("a", F.col("m").alias("b"))).distinct())  # small star
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return own.select("rec_id").join(links.select(F.col("a").alias("rec_id"), "b"), "rec_id", "left").select("rec_id", F.coalesce("b", "rec_id").alias("cluster_id"))


def cluster_labels(records: DataFrame, radius: float = RADIUS, cell: int = CELL) -> DataFrame:
    """``rec_id, cluster_id``: every record alike to at least one other of its panel.

    The distance of two records is half the sum of absolute differences of their triples, scaled to sum 1, averaged over the
    individuals with information in both; records are alike up to ``radius``.  A cluster holds all records joined by
    likeness (density clustering in which one neighbour makes a core point), cluster_id is its smallest rec_id.

    Records with null ids, null genos or a length other than 3 * nind, and those without any information, belong to no cluster;
    null, negative or infinite values and triples without a positive sum have no information; a record delivered again counts
    once; records of one panel with unequal nind aren't compared; other columns are ignored.

    No link is lost at any size, but the work for a panel whose reduced vectors don't spread grows with the square of its size.
    """
    return merge_local(cut(local_clusters(records, radius, cell)))


# medoids


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for (n,), at in _groups(b["nind"]):
            vec = pa.array([v.tobytes() for v in _pack(*_values(b["genos"], at, n))], pa.binary())
            yield pa.RecordBatch.from_arrays([b["rec_id"].take(pa.array(at)), b["nind"].take(pa.array(at)), vec], ["rec_id", "nind", "vec"])


def _whole(raw: list[bytes], nind: int) -> tuple[np.ndarray, np.ndarray]:
    """Triples as whole multiples of 1 / SCALE, and the information mask: sums of distances are exact."""
    q = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), nind, 2)
    info = q[:, :, 0] != 0xFFFF
    x = np.zeros((len(raw), nind, 3), np.int32)
    x[:, :, :2] = q
    x[:, :, 2] = np.maximum(SCALE - x[:, :, 0] - x[:, :, 1], 0)
    x[~info] = 0
    return x, info


def distances(x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray) -> np.ndarray:
    """Distances of each record of x from each of y, NaN where they share no individual.

    What a record has at the individuals that the other lacks is part of the difference of the whole rows, and is taken off again.
    """
    a, b = x.reshape(len(x), -1), y.reshape(len(y), -1)
    total = np.empty((len(x), len(y)))
    part = np.empty_like(b)
    for k in range(len(a)):
        np.subtract(b, a[k], out=part)
        total[k] = np.abs(part, out=part).sum(axis=1, dtype=np.int64)
    total -= x.sum(axis=2).astype(float) @ (~yi.T).astype(float) + (~xi).astype(float) @ y.sum(axis=2).T.astype(float)
    n = xi.astype(float) @ yi.T.astype(float)
    return np.where(n > 0, total / (2 * SCALE * np.maximum(n, 1)), np.nan)


def _mean_distance(d: np.ndarray) -> np.ndarray:
    """Mean distance of each row to the other members, 0 without any."""
    n = (~np.isnan(d)).sum(axis=1)
    return np.nansum(d, axis=1) / np.maximum(n, 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each cluster, which come one after the other."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r["cluster_id"] != held[0]["cluster_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], [x.split()[0] for x in _RANKED.split(", ")])


def _small_medoids(batches: Iterator[pa.RecordBatch], typical: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for rows in _runs(batches):
        ids = np.array([r["rec_id"] for r in rows])
        x, info = _whole([r["vec"] for r in rows], rows[0]["nind"])
        d = distances(x, info, x, info)
        np.fill_diagonal(d, np.nan)
        far = _mean_distance(d)
        best = np.lexsort((ids, np.round(far, 6)))[:typical]
        out += [(rows[0]["cluster_id"], len(rows), k + 1, int(ids[i]), float(far[i])) for k, i in enumerate(best)]
        if len(out) > 5000:
            yield _ranked(out)
            out = []
    yield _ranked(out)


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _whole(rows["vec"].to_pylist(), rows["nind"][0].as_py())


def _edges(key: tuple, sample: pa.Table) -> pa.Table:
    """Edges (individuals x 3 x BINS - 1) between bins that hold about as many members of a sample each; any edges give valid bounds."""
    x, info = _members(sample)
    edges = np.zeros((x.shape[1], BINS - 1, 3), np.int32)
    for k in range(x.shape[1]):
        v = np.sort(x[info[:, k], k], axis=0)
        if len(v):
            edges[k] = v[np.arange(1, BINS) * len(v) // BINS]
    return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int64()), "edges": pa.array([edges.transpose(0, 2, 1).tobytes()], pa.binary())})


def histograms(x: np.ndarray, info: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row an individual, all of which add up over portions: the number of members; for each genotype and bin the number and sum of the
    values, plain and times the member's informed individuals; for each other individual that a member lacks, the number of members and
    their summed distance from the middle edges."""
    n, nind, _ = x.shape
    own = info.sum(axis=1).astype(float)[:, None]
    hist = np.empty((nind, 4, 3 * BINS))
    for k in range(nind):
        v, w = x[:, k].astype(float), np.broadcast_to(info[:, k, None], (n, 3))
        at = np.stack([np.searchsorted(edges[k, c], x[:, k, c], "right") + c * BINS for c in range(3)], axis=1).ravel()
        hist[k] = [np.bincount(at, z.ravel(), 3 * BINS) for z in (w * 1.0, w * v, w * own, w * v * own)]
    parts = [np.full((nind, 1), float(n)), hist.reshape(nind, -1)]
    if nind <= PAIRED:
        lacks = (~info).astype(float)
        parts += [info.T.astype(float) @ lacks, _from_middle(x, info, edges).T @ lacks]
    return np.hstack(parts)


def _from_middle(x: np.ndarray, info: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.abs(x - edges[:, :, BINS // 2]).sum(axis=2) * info.astype(float)


def least_mean_distance(x: np.ndarray, info: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A lower bound of each record's mean distance to the other members of its cluster, of which ``table`` has the added histograms.

    With a the summed difference of two members over the r individuals that both have, the sum of a / r is at least (sum of a)^2 / (sum of a * r).
    Sums of differences from all members follow from the counts and sums of the bins, but for the record's own bin, where the difference of
    the sums is a lower bound and the chord over the bin an upper one.  r is at most the informed individuals of either; it is their
    sum less all individuals plus those that both lack, whose share in the sum is bounded by way of the middle edges.
    """
    n, nind, _ = x.shape
    own = info.sum(axis=1).astype(float)
    least, most, most_own = np.zeros(n), np.zeros(n), np.zeros(n)
    hist = table[:, 1 : 1 + 12 * BINS].reshape(nind, 2, 2, 3, BINS)
    for k in range(nind):
        for c in range(3):
            v, edge = x[:, k, c].astype(float), edges[k, c]
            at = np.searchsorted(edge, x[:, k, c], "right")
            low, high = np.r_[0, edge][at], np.r_[edge, SCALE + 1][at]
            share = (v - low) / np.maximum(high - low, 1)
            for weighted in (0, 1):
                count, total = hist[k, weighted, :, c]
                below, under = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(total)]
                other = below[at] * v - under[at] + (under[-1] - under[at + 1]) - v * (below[-1] - below[at + 1])
                chord = (1 - share) * (total[at] - count[at] * low) + share * (count[at] * high - total[at])
                if weighted:
                    most_own += info[:, k] * (other + chord)
                else:
                    least += info[:, k] * (other + np.abs(count[at] * v - total[at]))
                    most += info[:, k] * (other + chord)
    weight = np.minimum(own * most, most_own)
    if nind <= PAIRED:
        number, far = np.split(table[:, 1 + 12 * BINS :], 2, axis=1)
        both_lack = ((_from_middle(x, info, edges) @ number + info.astype(float) @ far) * ~info).sum(axis=1)
        weight = np.minimum(weight, most_own - (nind - own) * least + both_lack)
    bound = np.where((least > 0) & (weight > 0), least**2 / np.where(weight > 0, weight, 1), 0)
    return bound * (1 - 1e-9) / (2 * SCALE * max(table[0, 0] - 1, 1))


def _tables(key: tuple, members: pa.Table, bins: pa.Table) -> pa.Table:
    rows = np.empty((0, 0))
    if len(members):
        x, info = _members(members)
        rows = histograms(x, info, np.frombuffer(bins["edges"][0].as_py(), np.int32).reshape(-1, 3, BINS - 1))
    return pa.table({"cluster_id": pa.array([key[0].as_py()] * len(rows), pa.int64()), "k": pa.array(range(len(rows)), pa.int32()), "sums": pa.array([r.tobytes() for r in rows], pa.binary())})


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(len(rows["sums"][0].as_py()) // 8)
    for r in rows["sums"]:
        total += np.frombuffer(r.as_py())
    return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int64()), "k": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _bounded(members: pa.Table, bins: pa.Table) -> pa.Table:
    least = np.empty(0)
    if len(members):
        x, info = _members(members)
        sums = sorted((r["k"], r["sums"]) for r in bins["sums"][0].as_py())
        table = np.frombuffer(b"".join(r for _, r in sums)).reshape(x.shape[1], -1)
        least = least_mean_distance(x, info, np.frombuffer(bins["edges"][0].as_py(), np.int32).reshape(-1, 3, BINS - 1), table)
    return members.select(["cluster_id", "rec_id", "nind", "vec"]).append_column("least", pa.array(least, pa.float64()))


def _compared(key: tuple, members: pa.Table, candidates: pa.Table) -> pa.Table:
    """Summed distances of the candidates from the members at hand, and their numbers."""
    ids = np.asarray(candidates["rec_id"])
    far, n = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for at in range(0, len(members), WHOLE):
        some = members.slice(at, WHOLE)
        y, yi = _members(some)
        rec = np.asarray(some["rec_id"])
        for lo in range(0, len(ids), BLOCK):
            d = distances(*_members(candidates.slice(lo, BLOCK)), y, yi)
            d[ids[lo : lo + BLOCK, None] == rec] = np.nan
            far[lo : lo + BLOCK] += np.nansum(d, axis=1)
            n[lo : lo + BLOCK] += (~np.isnan(d)).sum(axis=1)
    return pa.table({"cluster_id": pa.array([key[0].as_py()] * len(ids), pa.int64()), "rec_id": pa.array(ids, pa.int64()), "far": pa.array(far), "n": pa.array(n)})


def _mean_distances(members: DataFrame, candidates: DataFrame, block: int) -> DataFrame:
    """``cluster_id, rec_id, mean_distance`` of candidates: blocks of about ``block`` are compared with each part of their cluster."""
    by = ["cluster_id", "part", "block"]
    blocks = candidates.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    parts = members.groupBy("cluster_id").agg(F.max("part").alias("__last")).select("cluster_id", F.explode(F.sequence(F.lit(0), "__last")).alias("part"))
    left = members.join(blocks, "cluster_id").select("cluster_id", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rec_id", "nind", "vec")
    dealt = candidates.join(blocks, "cluster_id").withColumn("block", F.pmod(F.xxhash64("rec_id", F.lit(1)), "blocks").cast("int"))
    right = dealt.join(parts, "cluster_id").select(*by, "rec_id", "nind", "vec")
    far = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compared, "cluster_id bigint, rec_id bigint, far double, n bigint")
    return far.groupBy("cluster_id", "rec_id").agg((F.sum("far") / F.greatest(F.sum("n"), F.lit(1))).alias("mean_distance"))


def _large_medoids(large: DataFrame, typical: int, whole: int) -> DataFrame:
    """``cluster_id, rec_id, mean_distance`` of all members that can be medoids, compared with their whole cluster."""
    by = ["cluster_id", "salt"]
    ends = large.groupBy("cluster_id").agg(F.min("salt").alias("salt"), F.max("salt").alias("__last"))
    portions = ends.select("cluster_id", F.explode(F.sequence(F.lit(0), "__last")).alias("salt"))
    edges = cut(large.join(ends.select(*by), by, "left_semi").groupBy("cluster_id").applyInArrow(_edges, "cluster_id bigint, edges binary"))
    tables = large.groupBy(*by).cogroup(edges.join(portions, "cluster_id").groupBy(*by)).applyInArrow(_tables, "cluster_id bigint, k int, sums binary")
    tables = tables.groupBy("cluster_id", "k").applyInArrow(_added, "cluster_id bigint, k int, sums binary")
    tables = cut(tables.groupBy("cluster_id").agg(F.collect_list(F.struct("k", "sums")).alias("sums")).join(edges, "cluster_id"))
    bounds = large.groupBy(*by).cogroup(tables.join(portions, "cluster_id").groupBy(*by))
    bounds = cut(bounds.applyInArrow(_bounded, "cluster_id bigint, rec_id bigint, nind int, vec binary, least double"))
    members = large.withColumn("part", F.floor(F.col("salt") / PARTS).cast("int"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("least", "rec_id"))
    first = cut(_mean_distances(members, bounds.withColumn("k", rank).where(F.col("k") <= max(FIRST, typical)), PARTS * whole))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("mean_distance"))
    limit = first.withColumn("k", rank).where(F.col("k") <= typical).groupBy("cluster_id").agg(F.max("mean_distance").alias("limit"))
    open_ = bounds.join(limit, "cluster_id").where(F.col("least") <= F.col("limit") + 2e-6)  # means are ranked rounded to 1e-6
    open_ = cut(open_.join(first.select("cluster_id", "rec_id"), ["cluster_id", "rec_id"], "left_anti"))
    if open_.limit(1).count() == 0:
        return first
    return first.unionByName(_mean_distances(members, open_, PARTS * whole))


def typical_members(records: DataFrame, labels: DataFrame, typical: int = 3, whole: int = WHOLE) -> DataFrame:
    """``cluster_id, size, medoid_rank, rec_id, mean_distance``: each cluster's size and its ``typical`` medoids, the records with the smallest
    mean distance to the other members they share an individual with (ties by 1e-6: the smaller rec_id first).

    Members are brought together once, by cluster, a cluster of more than ``whole`` records in portions of about so many.  A smaller
    cluster is compared within itself.  In a larger one, histograms added up over the portions give a lower bound of each member's mean distance;
    the FIRST members by it are compared with all others, and then every member whose bound doesn't rule it out.  The medoids are exact at
    any size; where little is ruled out (half of the individuals missing, say) the work grows with the square of the cluster.
    """
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sized = labels.join(sizes, "cluster_id")
    packed = _usable(records).select("rec_id", "nind", "genos").mapInArrow(_packed, "rec_id bigint, nind int, vec binary")
    salt = F.pmod(F.xxhash64("rec_id"), F.ceil(F.col("size") / whole)).cast("int")
    rows = packed.join(sized, "rec_id").dropDuplicates(["rec_id"]).select("cluster_id", salt.alias("salt"), "rec_id", "size", "nind", "vec")  # a record delivered again counts once
    rows = cut(rows.repartition("cluster_id", "salt").sortWithinPartitions("cluster_id", "salt", "rec_id"))
    small = rows.where(F.col("size") <= whole).mapInArrow(lambda x: _small_medoids(x, typical), _RANKED)
    large = rows.where(F.col("size") > whole)
    if large.limit(1).count() == 0:
        return small
    far = _large_medoids(large, typical, whole)
    best = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("mean_distance", 6), "rec_id")).cast("int")
    ranked = far.withColumn("medoid_rank", best).where(F.col("medoid_rank") <= typical).join(sizes, "cluster_id")
    return small.unionByName(ranked.select("cluster_id", "size", "medoid_rank", "rec_id", "mean_distance"))


def describe_clusters(records: DataFrame, radius: float = RADIUS, cell: int = CELL, typical: int = 3) -> DataFrame:
    """``typical_members`` of the clusters of ``cluster_labels``."""
    return typical_members(records, cut(cluster_labels(records, radius, cell)), typical)
