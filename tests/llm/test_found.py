"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
from collections import defaultdict
from pathlib import Path
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import clusters, leaks, mixing, percentiles, pieces, reading
from lociforge.llm.words import Buckets, words

# percentiles


def test_percentiles_merge_and_match_brute_force(spark):
    rng = Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, float("nan"), float(rng.randrange(50)), -3.5]), "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double, value string")
    one = percentiles.value_counts(df, ["g"], "v")
    halves = [percentiles.value_counts(df.where(c), ["g"], "v") for c in ("v < 20", "v >= 20 or v is null")]
    want = {}
    for g in (1, 2, None):
        v = sorted(x for k, x, _ in rows if k == g and x is not None and x == x)
        want[g] = (len(v), *(next(x for i, x in enumerate(v) if (i + 1) * 100 >= q * len(v)) for q in (0.1, 5, 50, 100)))
    for counts in (one, percentiles.merge_counts(halves, ["g"])):
        got = {r[0]: tuple(r[1:]) for r in percentiles.percentiles(counts, ["g"], [0.1, 5, 50, 100]).collect()}
        assert got == want
    assert percentiles.percentiles(percentiles.value_counts(df.limit(0), ["g"], "v"), ["g"], [50]).count() == 0


def test_rounded_values_bound_the_error(spark):
    df = spark.range(1, 100_000).selectExpr("1 as g", "id * 1.0 as v")
    counts = percentiles.value_counts(df, ["g"], "v", digits=3)
    assert counts.count() < 5000
    assert abs(percentiles.percentiles(counts, ["g"], [50]).first()["p50"] / 50_000 - 1) < 0.005


def test_sites_count_once(spark):
    rows = [(1, 1, 0, 5, [1, None, 2, 0], 1), (1, 1, 0, 5, [1, None, 2, 0], 2), (None, 1, 0, 5, None, 1), (None, 1, 0, 5, None, 1), (2, 1, 0, None, [], 1)]
    df = spark.createDataFrame(rows, "site_id bigint, run_id bigint, ref_id int, posi int, counts array<int>, field int")
    assert {tuple(r) for r in percentiles.site_values(df, "run_id").collect()} == {(1, "depth", 3, 1), (1, "depth", 0, 1), (1, "posi", 5, 3)}


# pieces


def check_pieces(posi, cut, win, step, gap):
    posi = sorted(set(posi))
    assert set(posi) == {p for p in posi if any(a <= p <= b for a, b, _, _ in cut)}
    assert all(b - a + 1 <= win for a, b, _, _ in cut)
    for (a, b, kind, run), (c, _, kind2, run2) in zip(cut, cut[1:]):
        if kind == kind2 == "inside" and run == run2:
            assert b - c + 1 == win - step
        else:
            before = max(p for p in posi if p <= b)
            assert c > b and min(p for p in posi if p > before) - before > gap
    for r in {x[3] for x in cut if x[2] == "inside"}:
        sizes = [b - a + 1 for a, b, _, x in cut if x == r]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == -(-(max(b for _, b, _, x in cut if x == r) - r + 1 - (win - step)) // step)


@pytest.mark.parametrize("tile", [1 << 16, 64, 7])
def test_pieces_keep_the_rules(spark, tile, monkeypatch):
    monkeypatch.setattr(pieces, "PROBLEM", 3)
    rows, want, limits = [], {}, {}
    for seed in range(10):
        rng = Random(seed)
        win, step, gap = 50, [50, 40, 10, 1][seed % 4], 6
        limits[seed] = (win, step, gap)
        posi, x = [], rng.randrange(100)
        for _ in range(rng.randrange(2, 300)):
            x += rng.choice([1, 2, 3, 5, 7, 9, 30] if seed % 2 else [1, 3, 5, 8, 200])
            posi.append(x)
        rows += [(seed, seed, p) for p in posi]
        want[seed] = posi
    args = spark.createDataFrame([(k, *v) for k, v in limits.items()], "args_id int, win int, step int, min_gap int")
    monkeypatch.setattr(pieces, "TILE", tile)
    got = defaultdict(list)
    for r in pieces.pieces(spark.createDataFrame(rows, "block_id bigint, args_id int, posi int"), args, tile).collect():
        got[r["block_id"]].append((r["piece_start"], r["piece_stop"], r["cut"], r["run_start"]))
    assert set(got) == set(want)
    for k, posi in want.items():
        check_pieces(posi, sorted(got[k]), *limits[k])


def test_cut_points_are_optimal():
    first = np.array([0, 12, 25, 31, 47, 60, 78])
    last = np.array([8, 20, 27, 40, 55, 70, 90])
    win = 45
    got = pieces.cut_points(first, last, win)
    gap = np.r_[np.inf, first[1:] - last[:-1]].astype(float)
    even = 91 / -(-91 // win)

    def cost(begins):
        ends = [*begins[1:], len(first)]
        if any(last[e - 1] - first[b] + 1 > win for b, e in zip(begins, ends)):
            return np.inf
        return sum(((last[e - 1] - first[b] + 1 - even) / win) ** 2 for b, e in zip(begins, ends)) + sum(1 + 1 / (1 + gap[b] / np.median(gap[1:])) for b in begins[1:])

    ways = [[0, *(i for i in range(1, 7) if m >> i & 1)] for m in range(0, 128, 2)]
    assert cost(got) == pytest.approx(min(map(cost, ways)))


def test_oversized_blocks(spark):
    rows = [(1, 1, p) for p in (5, 9, 30, 90, 5, None)] + [(2, 1, p) for p in range(0, 200, 4)] + [(3, 9, 0), (3, 9, 10**6), (4, None, 1), (None, 1, 1), (5, 1, 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "block_id bigint, args_id int, posi int, win int, cut string")
    args = spark.createDataFrame([(1, 50, 40, 10), (1, 50, 40, 10)], "args_id int, win int, step int, min_gap int")
    for tile in (1 << 16, 8):
        cut = pieces.pieces(df, args, tile)
        assert {tuple(r) for r in pieces.oversized(cut).collect()} == {(1, "item", 5), (2, "item", 0), (2, "run", 0)}
        by = defaultdict(list)
        for r in cut.collect():
            by[r["block_id"]].append(r)
        assert len(by[3]) == len(by[4]) == len(by[5]) == 1 and set(by) == {1, 2, 3, 4, 5}
        sites = pieces.piece_sites(df, cut, tile).collect()
        assert {(r["block_id"], r["posi"]) for r in sites} == {(b, p) for b, _, p in rows if b is not None and p is not None}
    assert pieces.pieces(df.limit(0), args).count() == 0


# clusters


def panel(rng, n_base, copies, nind, panel_id=1, first=0):
    base = rng.integers(0, 3, (n_base, nind))
    rows = []
    for k in range(n_base):
        for _ in range(copies if k % 2 else 1):
            g = np.full((nind, 3), 0.05)
            g[np.arange(nind), base[k]] = 0.9
            g = g + rng.uniform(0, 0.03, g.shape)
            g[rng.random(nind) < 0.08] = 1 / 3
            rows.append((first + len(rows), panel_id, nind, (g * rng.choice([1.0, 7.0], (nind, 1))).ravel().tolist()))
    return rows


def brute_clusters(rows, radius=0.18):
    out, by = {}, defaultdict(list)
    for r in {r[0]: r for r in rows if r[3] is not None and len(r[3]) == 3 * r[2]}.values():
        by[r[1]].append(r)
    for rs in by.values():
        t, info = clusters.triples(np.array([r[3] for r in rs], float), rs[0][2])
        comp = list(range(len(rs)))
        hit = set()
        for i in range(len(rs)):
            for j in range(i):
                both = info[i] & info[j]
                if both.any() and 0.5 * np.abs(t[i] - t[j]).sum(axis=1)[both].mean() <= radius:
                    hit |= {i, j}
                    a, b = comp[i], comp[j]
                    comp = [a if c == b else c for c in comp]
        for i in hit:
            out[rs[i][0]] = min(rs[j][0] for j in hit if comp[j] == comp[i])
    return out


@pytest.mark.parametrize("cell", [4096, 40])
def test_clusters_against_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    rows = panel(rng, 40, 6, 40) + panel(rng, 10, 4, 30, 2, 1000)
    rows += [rows[3], (5000, 1, 40, None), (5001, 1, 40, [1.0]), (5002, 1, 40, [1 / 3] * 120), (5003, 1, 40, [1 / 3] * 120)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_id bigint, panel_id int, nind int, genos array<double>, cell string")
    labels = clusters.cluster_labels(df, cell=cell)
    want = brute_clusters(rows)
    got = {r["rec_id"]: r["cluster_id"] for r in labels.collect()}
    assert got == want
    top = clusters.typical_members(df, labels).where("medoid_rank = 1").collect()
    assert {r["cluster_id"] for r in top} == set(want.values())
    assert all(r["size"] == sum(c == r["cluster_id"] for c in want.values()) and want[r["rec_id"]] == r["cluster_id"] for r in top)
    assert clusters.cluster_labels(df.limit(0)).count() == 0 and clusters.describe_clusters(df.limit(0)).count() == 0


def test_large_panels_are_compared_as_a_whole(spark):
    rng = np.random.default_rng(8)
    nind, rows = 60, []
    for k in range(60):  # pairs whose genotypes differ fully at a sixth of the individuals, and agree elsewhere
        base = rng.integers(0, 3, nind)
        far = base.copy()
        far[rng.choice(nind, 10, replace=False)] += 1
        rows += [(2 * k + j, 1, nind, np.eye(3)[g % 3].ravel().tolist()) for j, g in enumerate((base, far))]
    want = brute_clusters(rows)
    assert len(want) == len(rows)
    df = spark.createDataFrame(rows, "rec_id bigint, panel_id int, nind int, genos array<double>")
    got = {r["rec_id"]: r["cluster_id"] for r in clusters.cluster_labels(df, cell=4).collect()}
    assert got == want


def test_typical_members_are_those_of_the_whole_cluster(spark, monkeypatch):
    rows = panel(np.random.default_rng(6), 6, 30, 40)
    df = spark.createDataFrame([*rows, rows[1]], "rec_id bigint, panel_id int, nind int, genos array<double>")
    by = defaultdict(list)
    for rec, c in brute_clusters(rows).items():
        by[c].append(rec)
    want = {}
    for c, recs in by.items():
        t, info = clusters.triples(np.array([rows[k][3] for k in recs]), 40)
        both = (info[:, None] & info[None]).sum(axis=2)
        d = (0.5 * np.abs(t[:, None] - t[None]).sum(axis=3) * (info[:, None] & info[None])).sum(axis=2) / both
        far = d.sum(axis=1) / (len(recs) - 1)
        want |= {(c, k + 1): (len(recs), far[i]) for k, i in enumerate(np.argsort(far, kind="stable")[:3])}
    labels = clusters.cluster_labels(df, cell=20)
    for whole in (1024, 7):  # compared within itself; in portions, from a shortlist
        got = {(r["cluster_id"], r["medoid_rank"]): (r["size"], r["mean_distance"]) for r in clusters.typical_members(df, labels, whole=whole).collect()}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def lopsided(rng, n, nind):
    """Records whose mean profile lies among a few decoys, away from the medoids."""
    kind = rng.choice([0.05, 0.35, 0.85], n, p=[0.55, 0.21, 0.24])
    b = kind[:, None] + rng.uniform(-0.05, 0.05, (n, nind)) * rng.uniform(0, 1, (n, 1))
    g = np.stack([1 - b, b * 0.6, b * 0.4], axis=2)
    g[rng.random((n, nind)) < rng.choice([0, 0.1, 0.4], n)[:, None]] = 1 / 3
    g[:, 0] = np.stack([1 - b, b * 0.6, b * 0.4], axis=2)[:, 0]
    return g


def test_medoids_of_large_clusters_are_exact(spark):
    n, nind, rng = 400, 7, np.random.default_rng(12)
    g = lopsided(rng, n, nind)
    x, info = clusters._whole([v.tobytes() for v in clusters._pack(*clusters.triples(g.reshape(n, -1), nind))], nind)
    both = info[:, None] & info[None]
    d = (np.abs(x[:, None] - x[None]).sum(axis=3) * both).sum(axis=2) / (2 * clusters.SCALE * both.sum(axis=2))
    far = d.sum(axis=1) / (n - 1)
    want = [(k + 1, int(i), n) for k, i in enumerate(np.lexsort((np.arange(n), np.round(far, 6)))[:3])]
    df = spark.createDataFrame([(k, 1, nind, v.ravel().tolist()) for k, v in enumerate(g)], "rec_id bigint, panel_id int, nind int, genos array<double>")
    labels = df.selectExpr("rec_id", "0L as cluster_id")
    for whole in (1024, 100, 9):
        got = clusters.typical_members(df, labels, whole=whole).orderBy("medoid_rank").collect()
        assert [(r["medoid_rank"], r["rec_id"], r["size"]) for r in got] == want
        assert [r["mean_distance"] for r in got] == pytest.approx([far[i] for _, i, _ in want], abs=1e-9)


@pytest.mark.parametrize("paired", [512, 0])
def test_bounds_of_mean_distances_hold(monkeypatch, paired):
    monkeypatch.setattr(clusters, "PAIRED", paired)
    rng = np.random.default_rng(13)
    for missing in (0, 0.1, 0.5, 0.95):
        g = np.concatenate([lopsided(rng, 120, 9), np.eye(3)[rng.integers(0, 3, (60, 9))], rng.dirichlet([0.3] * 3, (60, 9))])
        g[rng.random(g.shape[:2]) < missing] = 1 / 3
        x, info = clusters._whole([v.tobytes() for v in clusters._pack(*clusters.triples(g.reshape(len(g), -1), 9))], 9)
        d = clusters.distances(x, info, x, info)
        one = [[np.nan if not (m := info[i] & info[j]).any() else np.abs(x[i] - x[j])[m].sum() / (2 * clusters.SCALE * m.sum()) for j in range(len(x))] for i in range(len(x))]
        assert np.allclose(d, one, atol=1e-12, equal_nan=True)
        np.fill_diagonal(d, np.nan)
        far = clusters._mean_distance(d)
        for edges in (np.sort(rng.integers(0, clusters.SCALE, (9, 3, clusters.BINS - 1)), axis=2), np.zeros((9, 3, clusters.BINS - 1), int)):
            table = clusters.histograms(x[:100], info[:100], edges) + clusters.histograms(x[100:], info[100:], edges)
            least = clusters.least_mean_distance(x, info, edges, table)
            assert (least <= far).all()
        if not missing:
            assert least.max() > 0


def test_slices_keep_every_link(spark):
    rng = np.random.default_rng(11)
    nind, rows = 40, []
    for k in range(150):  # records that spread from one pure genotype to another, with up to a fifth of the individuals missing
        base = (rng.random(nind) < k / 150).astype(int) * 2
        for _ in range(rng.integers(1, 4)):
            g = np.eye(3)[np.where(rng.random(nind) < 0.08, 1, base)]
            g[rng.random(nind) < rng.choice([0, 0.2])] = 1 / 3
            rows.append((len(rows), 1, nind, g.ravel().tolist()))
    t, info = clusters.triples(np.array([r[3] for r in rows]), nind)
    low, high = clusters.reach(t, info, 0.18)
    i, j = clusters.alike(t.astype(np.float32), info, np.arange(len(rows)), np.arange(len(rows)), 0.18)
    assert len(i) > len(rows) and (np.maximum(low[i], low[j]) <= np.minimum(high[i], high[j])).all()
    edges, cost = clusters.choose_slices(low[:, 0], high[:, 0], np.ones(len(rows)))
    assert len(edges) and cost < len(rows) ** 2
    assert clusters.choose_slices(np.arange(100), np.arange(100) + 10, np.ones(100))[1] < 0.5 * 100**2
    assert not len(clusters.choose_slices(np.arange(10), np.arange(10) + 100, np.ones(10))[0])
    df = spark.createDataFrame(rows, "rec_id bigint, panel_id int, nind int, genos array<double>")
    want = brute_clusters(rows)
    for cell in (30, 120):
        assert {r["rec_id"]: r["cluster_id"] for r in clusters.cluster_labels(df, cell=cell).collect()} == want


def test_long_chains_merge(spark):
    n = 700
    order = list(range(n))
    Random(3).shuffle(order)
    local = [x for a, b in zip(order, order[1:]) for x in ((a, min(a, b)), (b, min(a, b)))] + [(n + 1, n + 1), (n + 2, n + 1)]
    got = {r["rec_id"]: r["cluster_id"] for r in clusters.merge_local(spark.createDataFrame(local, "rec_id bigint, local_id bigint")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {n + 1: n + 1, n + 2: n + 1}


def test_panel_without_any_information(spark):
    rows = [(k, 1, 2, [1 / 3] * 6) for k in range(3)]
    df = spark.createDataFrame(rows, "rec_id bigint, panel_id int, nind int, genos array<double>")
    assert clusters.cluster_labels(df).count() == 0


def test_a_later_record_meets_every_member():
    import pyarrow as pa

    g = np.zeros((3, 100), int)
    g[1:, :5] = 1  # 0.05 from the first
    g[2, 5:22] = 1  # 0.17 from the second, 0.22 from the first
    t, info = clusters.triples(np.eye(3)[g].reshape(3, -1), 100)
    vec = [v.tobytes() for v in clusters._pack(t, info)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 3), pa.array([100] * 3), pa.array([0] * 3), pa.array([1, 2, 3]), pa.array(vec, pa.binary())], ["panel_id", "nind", "cell", "rec_id", "vec"])
    rows = [r for b in clusters._cluster_partition(iter([batch]), 0.18) for r in b.to_pylist()]
    assert {r["rec_id"]: r["local_id"] for r in rows} == {1: 1, 2: 1, 3: 1}


# leaks


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = words(t or "")
        runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for d, x in docs:
            v = words(x or "")
            if any(tuple(v[k : k + 10]) in runs for k in range(len(v) - 9)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = Random(8)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "café", "ﬁsh"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([9, 10, 25, 40]))) for i in range(30)] + [(99, None), (98, ""), (97, "one two"), (3, None)]
    docs = []
    for d in range(400):
        t = text(rng.choice([5, 30, 60]))
        if d % 4 == 0:
            w = items[rng.randrange(30)][1].split()
            n = rng.choice([8, 9, 10, 11, 20])
            a = rng.randrange(max(1, len(w) - n + 1))
            t = t + " " + ("; " if d % 8 else "­ ").join(w[a : a + n]).upper() + " " + text(3)
        docs.append((d, t))
    docs += [(1000, None), (1001, " "), (1002, text(30_000) + " " + items[2][1]), (1003, items[2][1].replace(" ", "​ ")), (1003, items[2][1])]
    spec = "doc_id bigint, text string, item_id int"
    ddf = spark.createDataFrame([(*x, 1) for x in docs], spec)
    idf = spark.createDataFrame([(*x, 1) for x in items + items[:2]], "item_id bigint, text string, doc_id int")
    want = brute_leaks(docs, items)
    latent = leaks.fit(ddf)
    assert len(want) > 30
    for block in (5000, 7):
        monkeypatch.setattr(leaks, "ITEM_BLOCK", block)
        got = [(r["doc_id"], r["item_id"]) for r in leaks.leaks(ddf, idf, latent=latent).where("run_words >= 10").collect()]
        assert set(got) == want
        assert len(got) == len(want) + 1  # doc 1003 stands twice
    assert leaks.leaks(ddf.limit(0), idf).count() == 0
    assert leaks.leaks(ddf, idf.limit(0), latent=latent).count() == 0


def test_paraphrases_are_reported(spark):
    item = "the committee of the northern harbour decided to postpone the annual survey of grey seals until late autumn because of storms"
    near = item.replace("postpone", "delay").replace("until", "to")
    other = [" ".join(Random(i).choices(item.split() + ["rice", "pot", "water", "salt", "cook", "small"], k=30)) for i in range(60)]
    df = spark.createDataFrame([(1, near), *((i + 2, t) for i, t in enumerate(other))], "doc_id bigint, text string")
    got = leaks.leaks(df, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)] and got[0]["run_words"] < 10 and got[0]["lcs_share"] >= 0.8


def test_paraphrases_against_brute_force(spark):
    rng = Random(12)
    items = [(i, " ".join([f"name{i}x{j}" if j % 11 == 5 else f"w{rng.randrange(400)}" for j in range(rng.choice([24, 45, 60]))])) for i in range(25)]
    docs = []
    for i, t in items:
        for every in (5, 6):
            w = [f"z{rng.randrange(400)}" if j % every == 0 and not x.startswith("name") else x for j, x in enumerate(t.split())]
            docs.append((len(docs), " ".join([f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))] + w + ["end"] * rng.randrange(30))))
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string")
    latent = leaks.fit(ddf)
    want = set()
    for i, t in items:
        b = words(t)
        rare = leaks._Items([(i, t)], latent).rare[0]
        want |= {(d, i) for d, x in docs if leaks.lcs(b, words(x)) >= 0.8 * len(b) and len(rare & set(words(x))) >= 0.6 * len(rare)}
    assert len(want) > 40
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(ddf, spark.createDataFrame(items, "item_id bigint, text string"), latent=latent).collect()}
    assert got == want


def test_lcs():
    assert leaks.lcs(list("abcbdab"), list("bdcaba")) == 4 and leaks.lcs([], ["a"]) == 0


# mixing


def test_flight_keeps_expectations():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 400, 3000)
    pi = 0.37
    f = mixing.Flight(np.random.default_rng(1))
    got = [x for i, t in enumerate(tokens) for x in f.add((i,), int(t), pi)] + f.land()
    taken = np.array([s for _, s in sorted(got)])
    assert len(got) == 3000 and abs(taken.sum() - 3000 * pi) <= 2 and abs((taken * tokens).sum() - tokens.sum() * pi) <= 800
    share = np.mean([[s for _, s in sorted([x for i, t in enumerate([5, 9, 2, 7]) for x in (g.add((i,), t, 0.3))] + g.land())] for g in (mixing.Flight(np.random.default_rng(k)) for k in range(4000))], axis=0)
    assert np.abs(share - 0.3).max() < 0.05


@pytest.fixture(scope="module")
def tokenizer(tmp_path_factory):
    d = tmp_path_factory.mktemp("tok")
    lines = [base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)]
    (d / mixing.VOCABULARY).write_bytes(b"\n".join(lines))
    return str(d)


def test_mixture(spark, tokenizer):
    rows = [(i, " Big" if i % 3 else "BIG ", "x" * (10 + i % 7), 0) for i in range(3000)] + [(5000 + i, "small", "y" * 20, 0) for i in range(40)] + [(9000, None, "z", 0), (9001, "other", "z", 0), (9002, "small", None, 0), (9003, "small", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.1, 3), ("small", 0.1, 2), ("tiny", 0.0, 1), ("absent", 0.5, 9), (None, 0.2, 1)], "source_name string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, targets, tokenizer)
    r = {x["source_name"]: x for x in report.collect()}
    size = {"big": sum(len(t) for _, s, t, _ in rows if s and s.strip().lower() == "big"), "small": 800}
    total = sum(size.values())
    assert {k: r[k]["size"] for k in size} == size and r["absent"]["size"] == 0 and set(r) == {"big", "small", "tiny", "absent"}
    assert {k for k in r if r[k]["falls_short"]} == {"absent"} | ({"small"} if 3 * 800 < 0.1 * total else set())
    got = mixture.collect()
    assert len(got) == 3042 and all(0 <= x["copies"] <= (1 if x["source_name"] == "big" else 3) for x in got)
    used = sum(x["copies"] * x["n_tokens"] for x in got if x["source_name"] == "big")
    assert abs(used - 0.4 * total) < 40 and used == r["big"]["actual_tokens"]
    m2, r2 = mixing.mix(docs.limit(0), targets, tokenizer)
    assert m2.count() == 0 and r2.count() == 4


def test_long_texts_are_counted_whole(spark, tokenizer):
    df = spark.createDataFrame([(1, "a " * 200_000), (2, None), (3, " " * 300_000), (4, "x" * 100_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.count_tokens(df, ["doc_id"], tokenizers=tokenizer).collect()}
    assert got == {1: 400_000, 2: 0, 3: 300_000, 4: 100_000}


def test_counts_do_not_depend_on_cuts(monkeypatch):
    path = Path(mixing.TOKENIZERS, mixing.VOCABULARY)
    if not path.exists():
        pytest.skip("no vocabulary file")
    enc = mixing._encoding(path.read_bytes())
    rng = Random(4)
    parts = ["the ", "Straße", " \n\n ", "2024", "--", "don't", "   ", "é", "\u3000", "国際", " aaaa", "\x1c", "\t", "!?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["ab" * 700, " " * 900, "Reading of " + "z" * 500 + " ends"]
    want = [len(enc[0].encode_ordinary(t)) for t in texts]
    for chars in (10, 50, 300):
        monkeypatch.setattr(mixing, "CHARS", chars)
        assert [mixing.token_length(t, enc) for t in texts] == want


def test_draws_do_not_depend_on_partitions(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 100)
    docs = spark.createDataFrame([(i, "ab" if i % 4 else "ba", "x" * (1 + i * i % 37)) for i in range(900)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("ab", 0.3, 1), ("ba", 0.7, 4)], "source_name string, target_share double, max_repeats int")
    runs = []
    for df in (docs, docs.orderBy(F.desc("doc_id")).repartition(7)):
        mixture, report = mixing.mix(df, targets, tokenizer)
        runs.append(sorted(tuple(r) for r in mixture.collect()))
        assert all(abs(r["actual_tokens"] - min(r["target_tokens"], r["max_repeats"] * r["size"])) <= 2 * 37 for r in report.collect())
    assert runs[0] == runs[1]


# reading levels


def graded(rng, level, n):
    easy, hard = ["cat", "dog", "house", "ball", "red"], ["jurisprudence", "thermodynamic", "methodology", "incremental", "conductivity"]
    out = []
    for _ in range(n):
        sentences = []
        for _ in range(rng.randrange(2, 6)):
            w = [rng.choice(hard if rng.random() < (level - 1) / 4.5 else easy) for _ in range(3 + 3 * level)]
            sentences.append("The " + (", although the " if level > 3 else " and the ").join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]) + ".")
        out.append(" ".join(sentences))
    return out


def test_reading_levels_held_out(spark):
    rng = Random(6)
    docs = [(level * 1000 + i, t, level) for level in range(1, 6) for i, t in enumerate(graded(rng, level, 80))]
    extra = [(1, None, 0), (2, "  ", 0), (3, "12 % !", 0), (4, "word " * 50_000, 0)]
    df = spark.createDataFrame([(*x[:2], x[2]) for x in docs + extra], "doc_id bigint, text string, reading_level int")
    labels = [(d, lv if rng.random() > 0.05 else rng.randrange(1, 6)) for d, _, lv in docs if d % 2] + [(docs[1][0], None), (77, 9), (None, 3), (docs[3][0], docs[3][2])]
    ldf = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    got = {r["doc_id"]: r for r in reading.reading_levels(df, ldf).collect()}
    held = [(got[d]["demanding"] >= 0.5) == (lv >= 4) for d, _, lv in docs if d % 2 == 0]
    assert np.mean(held) > 0.95 and len(got) == len(docs) + 4
    assert all(got[d]["reading_level"] is None for d in (1, 2, 3)) and got[4]["reading_level"] is not None
    empty = reading.reading_levels(df, ldf.limit(0))
    assert empty.where("reading_level is not null").count() == 0 and reading.demanding(empty).count() == 0


def test_ordinal_model_recovers_the_order():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 4))
    level = 1 + np.digitize(x @ [2.0, -1, 0, 0] + 0.3 * rng.logistic(size=2000), [-3, -1, 1, 3])
    m = reading.fit_ordinal(x, level.astype(float))
    p = m.probabilities(x)
    assert np.allclose(p.sum(axis=1), 1) and (p >= -1e-12).all() and np.corrcoef(p @ np.arange(1, 6), level)[0, 1] > 0.9


def test_calibration_lowers_the_error():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 6))
    level = 1.0 + np.digitize(x @ [1.5, -1, 0.5, 0, 0, 0] + rng.logistic(size=4000), [-3, -1, 1, 3])
    ids = np.arange(4000)
    m = reading.fit_calibrated(x[:2000], level[:2000], ids[:2000])
    raw = reading.fit_ordinal(x[:2000], level[:2000])
    sharp = reading.Ordinal(raw.mean, raw.scale, raw.weights * 3, raw.cuts * 3)
    error = reading.calibration_error(m, x[2000:], level[2000:])
    assert error < 0.04 and reading.calibration_error(sharp, x[2000:], level[2000:]) > 2 * error
    assert reading.calibration_error(sharp.calibrated(sharp.score(x[:2000]), level[:2000]), x[2000:], level[2000:]) < 0.04


def test_sums_in_a_tree(spark, monkeypatch):
    from lociforge.llm import words as W

    monkeypatch.setattr(W, "FAN", 3)

    def fill(batches, total):
        for b in batches:
            for i in b.column(0).to_pylist():
                total[i % 50, i % 3] += i

    want = np.zeros((50, 3))
    for i in range(5000):
        want[i % 50, i % 3] += i
    assert np.array_equal(W.summed(spark.range(0, 5000, 1, 200), fill, (50, 3), block=7), want)
    assert not W.summed(spark.range(0), fill, (50, 3)).any()


def test_buckets_forget_but_stay_the_same():
    b = Buckets(64, most=3)
    first = b(["a", "b", "c", "d"])
    b(["e"])
    assert b(["a", "b", "c", "d"]) == first


def test_words():
    assert words("Straße ­of​ ﬁsh_42, Iİx!") == ["strasse", "of", "fish", "42", "ii", "x"] or words("Straße") == ["strasse"]
    assert words("so­ft zero​width") == ["soft", "zerowidth"]
