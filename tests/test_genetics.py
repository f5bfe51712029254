import math
from itertools import product

import numpy as np
import pytest

from lociforge.functions.genotypes import GENOTYPES
from lociforge.operators import association as A
from lociforge.operators import counting as C
from lociforge.operators import estimators as E
from lociforge.operators import iterative as I
from lociforge.operators import likelihood as L
from lociforge.operators import models as M
from lociforge.operators import quality as Q
from lociforge.operators import spectrum as S
from lociforge.plans.pipeline import Pipeline, register_operator


def ragged(rng, sites=20, most=8):
    sizes = rng.integers(0, most, sites)
    return E.Ragged(rng.random((sizes.sum(), 3)).ravel() + 1e-3, sizes)


def test_known_allele_frequency_likelihoods():
    # published values for three samples: all heterozygous-looking, one of each, all major-looking
    t = {0: [(0.1, 0.8, 0.1)] * 3, 1: [(0.8, 0.1, 0.1), (0.1, 0.8, 0.1), (0.1, 0.1, 0.8)], 2: [(0.8, 0.1, 0.1)] * 3}
    want = {
        0: [-5.345201, -3.265759, -1.405563, 0, -1.405563, -3.265759, -5.345201], 1: [-1.963610, -0.851204, -0.851204, 0, -0.851204, -0.851204, -1.963610],
        2: [0, -2.079442, -3.283414, -4.589666, -5.362856, -6.238325, -6.238325],
    }
    for k, rows in t.items():
        assert np.allclose(E.saf_matrix(np.array([rows])), [want[k]], atol=1e-6)
    assert np.allclose(E.saf_matrix(np.array([[(1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0)]])), [[-np.inf] * 3 + [0] + [-np.inf] * 3])


def test_saf_against_enumeration():
    rng = np.random.default_rng(0)
    l = rng.random((1, 3, 3))
    direct = np.zeros(7)
    for g in product(range(3), repeat=3):
        direct[sum(g)] += np.prod([l[0, i, x] * math.comb(2, x) for i, x in enumerate(g)])
    direct = np.log(direct / [math.comb(6, j) for j in range(7)])
    assert np.allclose(E.saf_matrix(l)[0], direct - direct.max())


def test_em_climbs_to_a_maximum():
    r = ragged(np.random.default_rng(1))
    p = E.em_frequency(r, rounds=2000, tol=1e-10)
    at = lambda q: E.log_likelihood(r, E.hwe_prior(np.clip(q, 0, 1)))
    some = r.sizes > 0
    assert (at(p) >= np.maximum(at(p - 1e-3), at(p + 1e-3)) - 1e-6)[some].all() and (p[~some] == 0).all()
    steps = [E.log_likelihood(r, E.hwe_prior(E.em_frequency(r, rounds=k, tol=0))) for k in (1, 2, 5, 20)]
    assert all((b >= a - 1e-9).all() for a, b in zip(steps, steps[1:]))
    same = E.em_frequency(r, inbreeding=np.zeros(len(r.l)), rounds=50)
    assert np.allclose(same, E.em_frequency(r, rounds=50))


def test_hwe_finds_inbreeding():
    l = np.array([[1, 1e-6, 1e-6]] * 50 + [[1e-6, 1e-6, 1]] * 50)
    p, f = E.em_hwe(E.Ragged(l.ravel(), np.array([100])))
    assert p[0] == pytest.approx(0.5, abs=0.01) and f[0] > 0.95
    assert E.chi2_tail(np.array([3.841459, -1.0])) == pytest.approx([0.05, 1.0], abs=1e-6) and E.chi2_threshold(0.05) == pytest.approx(3.841459, abs=1e-5)


def test_folding_and_bins():
    to, weight = S.fold_map((5,))
    assert to.tolist() == [0, 1, 2, 1, 0] and weight.tolist() == [1, 1, 2, 1, 1]
    assert S.spectrum_bins((2, 3))[:4] == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_fst_coefficients_of_fixed_and_equal_populations():
    a, b = S.fst_coefficients(4, 6)
    assert a.reshape(5, 7)[0, 6] == pytest.approx(b.reshape(5, 7)[0, 6]) and a.reshape(5, 7)[2, 3] < 0
    assert S.branch_statistics(0.114638, 0.121007, 0.069461) == pytest.approx((0.0894, 0.0324, 0.0396), abs=2e-3)


def saf_table(spark, rng, n_sites, n, seed_chr="1"):
    l = rng.random((n_sites, n, 3)) ** 3 + 1e-6
    s = E.saf_matrix(l)
    return spark.createDataFrame([(seed_chr, i, [float(v) for v in x]) for i, x in enumerate(s)], "chr string, pos int, saf array<double>"), s


def test_spectrum_em(spark):
    rng = np.random.default_rng(5)
    df, s = saf_table(spark, rng, 300, 3)
    x = np.full(7, 1 / 7)
    for _ in range(40):
        post = np.exp(s) * x
        x = (post / post.sum(axis=1, keepdims=True)).mean(axis=0)
    got = S.estimate_spectrum([df], (7,), rounds=40, method="em", tol=0)
    assert got.sum() == pytest.approx(300) and np.allclose(got / 300, x, atol=1e-8)
    for _ in range(3000):
        post = np.exp(s) * x
        x = (post / post.sum(axis=1, keepdims=True)).mean(axis=0)
    for method in ("squarem", "anderson"):
        assert np.allclose(S.estimate_spectrum([df], (7,), method=method) / 300, x, atol=1e-3)
    fast = S.estimate_spectrum([df], (7,), rounds=25)
    assert np.allclose(fast / 300, x, atol=1e-6)
    lik = lambda v: np.log((np.exp(s) * v / v.sum()).sum(axis=1)).sum()
    assert lik(fast) >= lik(got) - 1e-6
    folded = S.estimate_spectrum([df], (7,), rounds=20, folded=True)
    assert folded[4:].sum() == pytest.approx(0) and folded.sum() == pytest.approx(300)
    two = S.estimate_spectrum([df, saf_table(spark, rng, 200, 2)[0]], (7, 5), rounds=20)
    assert two.sum() == pytest.approx(200)
    w = S.bootstrap_weights(df, 1)
    assert 200 < w.agg({"weight": "sum"}).first()[0] < 400
    assert S.estimate_spectrum([df], (7,), rounds=3, weights=w).sum() == pytest.approx(w.agg({"weight": "sum"}).first()[0])
    th = S.site_thetas(S.site_posterior(df, x), 6).first()
    p = np.exp(s[th["pos"]]) * x
    p /= p.sum()
    assert th["tw"] == pytest.approx((1 - p[0] - p[6]) / sum(1 / i for i in range(1, 6))) and th["tp"] == pytest.approx(sum(i * (6 - i) * p[i] for i in range(7)) / 15)


def test_windows_cover_like_a_loop(spark):
    pos = [3, 8, 15, 16, 31, 44, 45, 90]
    df = spark.createDataFrame([("1", p) for p in pos], "chr string, pos int")
    for kind in (0, 1, 2):
        got = {(r["win_start"], r["win_stop"], r["pos"]) for r in S.sliding(df, "chr", "pos", 20, 10, kind).collect()}
        start = {0: 10, 1: 3, 2: 1}[kind]
        want = {(a, a + 20, p) for a in range(start, 90 - 20 + 1, 10) for p in pos if a <= p < a + 20}
        assert got == want


def test_exact_test_and_models():
    assert Q.fisher_two_tail(1, 9, 11, 3) == pytest.approx(0.002759456, abs=1e-8) and Q.fisher_two_tail(0, 0, 0, 0) == 1
    piles = [([0] * 10, [30] * 10, [False] * 10), ([0, 2] * 8, [30] * 16, [False] * 16), ([0, 1, 1, 3, 0, 0], [20, 20, 35, 9, 20, 35], [True, False] * 3), ([2] * 50 + [3] * 48, [25] * 98, [False, True] * 49)]
    flat = [np.concatenate([np.array(p[i]) for p in piles]) for i in range(3)]
    gl = M.dependent_errors(*flat, np.array([len(p[0]) for p in piles]))
    assert gl[0].argmax() == 0 and gl[0, 1] == pytest.approx(-10 * math.log(2)) and gl[0, 4] < -10
    assert GENOTYPES[gl[1].argmax()] == (0, 2) and GENOTYPES[gl[3].argmax()] == (2, 3)
    for p, got in zip(piles, gl):
        assert np.allclose(got, one_pile(*p), atol=1e-8)


def one_pile(base, q, rev):
    """The same model, one base at a time."""
    n, seen, count, total = len(base), {}, [0] * 4, [0.0] * 4
    for k in sorted(range(n), key=lambda k: (-q[k], not rev[k], -base[k])):
        e, b = 10 ** (-q[k] / 10), base[k]
        p = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(e) + (n - i) * math.log1p(-e)) for i in range(n + 1)]
        c = count[b]
        f = 0.83 ** seen.get((b, rev[k]), 0) * 0.97 + 0.03
        total[b] += f * -10 * (math.log10(max(sum(p[c + 1 :]), 1e-300)) - math.log10(max(sum(p[c:]), 1e-300)))
        count[b] += 1
        seen[b, rev[k]] = seen.get((b, rev[k]), 0) + 1
    out = []
    for a, c in GENOTYPES:
        x = sum(total[k] for k in range(4) if k not in (a, c))
        if a != c:
            x -= 10 * math.log10(math.comb(count[a] + count[c], count[a]) / 2 ** (count[a] + count[c]))
        out.append(-max(x, 0) * math.log(10) / 10)
    return np.array(out) - max(out)


def test_tails_and_deep_spectra():
    x = np.array([0.0, 1e-6, 0.5, 3.841459, 12.4, 12.6, 40, 700, -1])
    assert np.allclose(E.chi2_tail(x), [1 if v < 0 else math.erfc(math.sqrt(v / 2)) for v in x], rtol=1e-9, atol=0)
    l = np.full((1, 100, 3), 1e-4)
    l[:, :, 2] = 1
    s = E.saf_matrix(l)[0]
    assert np.isfinite(s).all() and s[0] == pytest.approx(100 * math.log(1e-4))


def test_saf_of_any_minor_stays_finite(spark):
    rng = np.random.default_rng(1)
    gl = np.log(rng.random((2, 100, 10)) * 1e-6 + 1e-40)
    gl[:, :, 9] = 0
    df = spark.createDataFrame([(1, p, s, [float(v) for v in gl[p, s]]) for p in range(2) for s in range(100)], "chr int, pos int, sample int, gl array<double>")
    got = M.saf_any_minor(df, spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "chr int, pos int, major int"), 100).collect()
    assert len(got) == 2
    for r in got:
        parts = []
        for m in (1, 2, 3):
            g = np.exp(gl[r["pos"]][:, [GENOTYPES.index((0, 0)), GENOTYPES.index((0, m)), GENOTYPES.index((m, m))]])[None]
            parts.append(E.log_saf(g)[0])
        want = np.logaddexp.reduce(parts)
        assert np.isfinite(r["saf"]).all() and np.allclose(r["saf"], want - want.max(), atol=1e-6)


def test_regressions():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 300), np.ones(300)]).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(float)
    b, lik, cov = A.fit_glm(x, y)
    eta = x @ b
    assert np.allclose(x.T @ (y - 1 / (1 + np.exp(-eta))), 0, atol=1e-6) and b[0] == pytest.approx(1, abs=0.5) and cov[0, 0] > 0
    count = rng.poisson(np.exp(0.4 * x[:, 0])).astype(float)
    assert A.fit_glm(x, count, "poisson")[0][0] == pytest.approx(0.4, abs=0.15)
    hard = np.eye(3)[x[:, 0].astype(int)]
    lrt, beta, _ = A.latent_em(hard, y, x[:, 1:], "logistic", np.array([0.0, 1, 2]))
    assert lrt == pytest.approx(2 * (lik - A.fit_glm(x[:, 1:], y)[1]), abs=1e-3) and beta == pytest.approx(b[0], abs=1e-3)


def test_score_test_matches_regression_for_hard_genotypes(spark):
    rng = np.random.default_rng(3)
    g, y = rng.integers(0, 3, 60), rng.integers(0, 2, 60).astype(float)
    post = spark.createDataFrame([(1, 5, i, *map(float, np.eye(3)[x])) for i, x in enumerate(g)], "chr int, pos int, sample int, p0 double, p1 double, p2 double")
    pheno = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(99, None)], "sample int, y double")
    n, r = 60, np.corrcoef(g, y)[0, 1]
    got = A.score_test(post, pheno, "binary").first()
    assert got["lrt"] == pytest.approx(n * r * r, rel=1e-6) and got["freq"] == pytest.approx(g.mean() / 2)
    assert A.score_test(post, pheno, "binary", min_count=1000).first()["lrt"] is None
    dosage = A.regress(post, pheno).first()
    assert dosage["beta"] == pytest.approx(np.polyfit(g, y, 1)[0])


def test_contamination_and_errors(spark):
    rng = np.random.default_rng(4)
    err = np.full((4, 4), 0.02) + np.eye(4) * 0.92
    rows = [tuple(int(v) for v in rng.multinomial(12, err[b])) for b in rng.integers(0, 4, 1500)]
    df = spark.createDataFrame(rows, "n_a int, n_c int, n_g int, n_t int")
    assert np.allclose(I.error_rates(df, 40), err, atol=0.01)
    x, eps = 0.15, 0.01
    sites = []
    for i in range(1500):
        f = rng.uniform(0.2, 0.9)
        sites.append((i, float(f), 20, int(rng.binomial(20, x * f * (1 - 4 * eps / 3) + eps)), 160, int(rng.binomial(160, eps))))
    s = spark.createDataFrame(sites, "snp int, freq double, depth int, other int, flank_depth int, flank_other int")
    m = I.contamination_moments(s).first()
    assert m["estimate"] == pytest.approx(x, abs=0.02) and 0 < m["se"] < 0.02 and I.contamination_likelihood(s) == pytest.approx(x, abs=0.02)


def test_admixture_separates_two_sources(spark):
    rng = np.random.default_rng(6)
    f = np.stack([rng.uniform(0.05, 0.3, 300), rng.uniform(0.7, 0.95, 300)], axis=1)
    rows = []
    for s in range(300):
        g = [rng.binomial(2, f[s, i // 5]) for i in range(10)]
        rows.append(("1", s, [float(v) for x in g for v in np.where(np.arange(3) == x, 0.98, 0.01)]))
    q, freqs, _ = I.admixture(spark.createDataFrame(rows, "chr string, pos int, l3 array<double>"), 10, 2)
    assert np.allclose(q.sum(axis=1), 1) and abs(q[:5, 0].mean() - q[5:, 0].mean()) > 0.9 and freqs.count() == 300


def test_pipeline_checks_what_it_needs(spark, tmp_path):
    rows = [(0, p, s, (p + s // 2) % 4, 30, 40, 5, 20, False, p % 4, p % 4, k) for p in range(3) for s in range(4) for k in range(8)]
    reads = spark.createDataFrame(rows, "chr int, pos int, sample int, base int, qs int, mapq int, posi int, isop int, is_rev boolean, ref int, anc int, ord int")
    with pytest.raises(ValueError, match="gl_gatk"):
        Pipeline(reads=reads).run("major_minor")
    p = Pipeline(reads=reads).run("gl_gatk").run("major_minor").run("three").run("frequency").run("posterior").run("genotypes")
    assert p["freq"].count() == 3 and {r["geno"] for r in p["geno"].collect()} == {0, 2}
    register_operator("twice", ("freq",), "double_freq", lambda freq: freq.selectExpr("chr", "pos", "2 * freq as freq2"))
    assert p.run("twice")["double_freq"].count() == 3
    p.run("counts").run("gate", min_depth=2, min_ind=1).run("hwe").run("hwe_filter", min_p=1e-6).run("psmc").run("statistics").run("statistic_filter", max_z=9)
    assert p["geno"].count() > 0 and p["psmc"].count() == 12 and p["statistics"].count() == 3
    p.write("freq", "mafs", None).write("freq", "mafs", str(tmp_path / "x.mafs"), "chromo", "position")
    assert spark.read.csv(str(tmp_path / "x.mafs"), sep="\t", header=True).count() == 3
    assert C.allele_counts(reads.limit(0)).count() == 0 and L.best_pair(L.pair_scores(L.gl_gatk(reads.limit(0)))).count() == 0


def test_streams(spark, tmp_path):
    from lociforge.streaming.windows import counts_stream, theta_windows_stream

    src = tmp_path / "in"
    rows = [("1", p, 0.5, 0.25, p % 4) for p in (1, 2, 11, 12, 25)]
    spark.createDataFrame(rows, "chr string, pos int, tw double, tp double, base int").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("chr string, pos int, tw double, tp double, base int").parquet(str(src))
    for name, df, mode in (("w", theta_windows_stream(stream, 10), "complete"), ("c", counts_stream(stream, 10), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r) for r in spark.table("w").collect()) == [("1", 0, 1.0, 0.5, 2), ("1", 1, 1.0, 0.5, 2), ("1", 2, 0.5, 0.25, 1)]
    assert sum(r["n_a"] + r["n_c"] + r["n_g"] + r["n_t"] for r in spark.table("c").collect()) == 5


def test_simulated_truth_is_recovered(spark):
    from lociforge.operators.simulate import simulate_reads

    reads = simulate_reads(spark, 300, 20, depth=8, variable=0.6).cache()
    again = simulate_reads(spark, 300, 20, depth=8, variable=0.6).repartition(7)
    assert reads.count() == again.count() == reads.intersectAll(again).count()
    sites = M.likelihood_sites(L.gl_gatk(reads))
    f = {r["pos"]: r for r in E.frequencies(sites).collect()}
    truth = {r["pos"]: r for r in reads.select("pos", "ref", "sample", "geno").distinct().groupBy("pos").agg({"geno": "avg", "ref": "max"}).withColumnRenamed("avg(geno)", "g").withColumnRenamed("max(ref)", "ref").collect()}
    off = [abs((f[p]["freq"] if f[p]["major"] == t["ref"] else 1 - f[p]["freq"]) - t["g"] / 2) for p, t in truth.items() if p in f]
    assert np.median(off) < 0.02 and np.mean(off) < 0.05
    long = M.long_likelihoods(sites)
    three = L.three(L.gl_gatk(reads), L.best_pair(L.pair_scores(L.gl_gatk(reads))))
    assert long.count() == three.count() == long.select("chr", "pos", "sample", "major", "minor").intersect(three.select("chr", "pos", "sample", "major", "minor")).count()
    calls = M.allele_set_calls(M.collected_gl(L.gl_gatk(reads), reads.groupBy("chr", "pos").agg({"ref": "max"}).withColumnRenamed("max(ref)", "major"))).collect()
    right = [(len(r["alleles"]) > 1 or r["qual"] > 13) == (truth[r["pos"]]["g"] > 0) for r in calls if truth[r["pos"]]["g"] == 0 or truth[r["pos"]]["g"] > 0.1]
    assert np.mean(right) > 0.9
    reads.unpersist()


def test_hidden_markov_posteriors():
    from lociforge.operators import coalescent as K

    start, trans, het = K.hidden_markov(4, 0.3, 0.1)
    assert np.allclose(trans.sum(axis=1), 1) and start.sum() == pytest.approx(1) and (np.diff(het) > 0).all()
    obs = np.array([0, 1, -1, 1])
    post, lik = K.forward_backward(obs, start, trans, het)
    total = np.zeros((4, 4))
    for s in product(range(4), repeat=4):
        p = start[s[0]] * np.prod([trans[a, b] for a, b in zip(s, s[1:])]) * np.prod([het[x] if o == 1 else 1 - het[x] if o == 0 else 1 for x, o in zip(s, obs)])
        for i, x in enumerate(s):
            total[i, x] += p
    assert np.allclose(post, total / total[0].sum()) and lik == pytest.approx(math.log(total[0].sum()))


def test_chains_do_not_depend_on_their_pieces(spark):
    from lociforge.operators import coalescent as K

    rng = np.random.default_rng(2)
    wins = sorted(int(w) + 7 for w in rng.choice(400, 150, replace=False))
    rows = [(c, w + 300 * (w > 200), bool(rng.random() < 0.3)) for c in "ab" for w in wins]
    df = spark.createDataFrame(rows, "chr string, win bigint, is_het boolean")
    got = {}
    for piece in (4096, 16):
        for r in K.decode(df, 5, 0.3, 0.1, piece=piece).collect():
            got.setdefault((r["chr"], r["win"]), []).append(r["mean_time"])
    assert len(got) == len(rows) and all(len(v) == 2 and abs(v[0] - v[1]) < 1e-9 for v in got.values())
    own = [r for r in rows if r[0] == "a"]
    obs = np.full(own[-1][1] - own[0][1] + 1, -1)
    for _, w, h in own:
        obs[w - own[0][1]] = h
    post, _ = K.forward_backward(obs, *K.hidden_markov(5, 0.3, 0.1))
    edges = K.time_grid(5)
    assert got["a", own[3][1]][0] == pytest.approx(post[own[3][1] - own[0][1]] @ ((edges[:-1] + edges[1:]) / 2))


def test_population_sizes_are_recovered(spark):
    from lociforge.operators import coalescent as K

    rng = np.random.default_rng(4)
    start, trans, het = K.hidden_markov(6, 0.4, 0.05, np.repeat([1.0, 4.0, 1.0], 2))
    rows = []
    for c in range(8):
        s = rng.choice(6, p=start)
        for w in range(2500):
            s = rng.choice(6, p=trans[s]) if w else s
            rows.append((c, w, bool(rng.random() < het[s])))
    df = spark.createDataFrame(rows, "chr int, win bigint, is_het boolean")
    sizes, theta, rho, lik = K.fit_sizes(df, 6, [2, 2, 2], 0.2, 0.1, rounds=6, piece=512)
    flat = K.fit_sizes(df, 6, [6], 0.2, 0.1, rounds=3, piece=512)
    assert lik > flat[3] and sizes[2] > 1.5 * sizes[0] and 0.2 < theta < 0.8


def test_blocks_and_checks(spark):
    df, s = saf_table(spark, np.random.default_rng(9), 25, 2)
    b = S.block_spectra(df, 10, 5).orderBy("block").collect()
    assert [r["n_sites"] for r in b] == [10, 10, 5] and sum(b[0]["sfs"]) == pytest.approx(10)
    assert S.check_positions(df).count() == 0 and S.check_positions(S.concatenated([df, df])).count() == 25
    assert S.variable_sites([df], [np.ones(5)]).count() == int(((s.argmax(axis=1) > 0) & (s.argmax(axis=1) < 4)).sum())


def test_alleles_are_oriented_by_expected_frequency(spark):
    rng = np.random.default_rng(9)
    rows = []
    for pos in range(40):
        a, b = rng.choice(4, 2, replace=False)
        share = rng.choice([0.0, 0.1, 0.3, 1.0])
        for s in range(8):
            rows += [(1, pos, s, int(b if rng.random() < share else a), 30) for _ in range(4)]
    gl = L.gl_gatk(spark.createDataFrame(rows, "chr int, pos int, sample int, base int, qs int"))
    sites = M.likelihood_sites(gl)
    f = E.frequencies(sites).collect()
    assert all(r["freq"] < 0.5 + 1e-6 for r in f)
    by = {}
    for _, pos, _, base, _ in rows:
        by.setdefault(pos, []).append(base)
    for r in f:
        seen = by[r["pos"]]
        assert seen.count(r["major"]) >= seen.count(r["minor"])
        if len(set(seen)) == 1:
            assert r["lrt"] < 1e-6 and r["major"] == seen[0]
    pairs = {(r["pos"], r["major"], r["minor"]) for r in L.best_pair(L.pair_scores(gl)).collect()}
    assert pairs == {(r["pos"], r["major"], r["minor"]) for r in f}


def test_published_association_statistics(spark):
    # fixed values: genotypes and phenotypes of 48 samples, and the published statistics
    geno, pheno = "001222222222222222222222222222222222222222222210", "111110001010111010100101010000000010000100000000"
    post = spark.createDataFrame([("1", 999_999, i, *map(float, np.eye(3)[int(x)])) for i, x in enumerate(geno)], "chr string, pos int, sample int, p0 double, p1 double, p2 double")
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(pheno)], "sample int, y double")
    lrt = lambda t: t.first()["lrt"]
    assert lrt(A.score_test(post, y)) == pytest.approx(1.607704, abs=1e-6) and lrt(A.score_test(post, y, "binary")) == pytest.approx(1.620294, abs=1e-6)
    assert lrt(A.score_test(post, y, dispersion=False)) == pytest.approx(1.586538, abs=1e-5)
    assert lrt(A.regress(post, y)) == pytest.approx(1.615975, abs=5e-4) and lrt(A.regress(post, y, "latent")) == pytest.approx(1.606574, abs=0.02)
    assert lrt(A.regress(post, y, "latent", "logistic")) == pytest.approx(1.540588, abs=1e-4) and lrt(A.regress(post, y, "dosage", "logistic")) == pytest.approx(1.540588, abs=1e-4)
    # the kernel gives the same without covariates, and covariates of no effect change little
    more = y.withColumn("one", (y["sample"] * 0.0 + 1.0))
    for kind in ("normal", "binary"):
        assert lrt(A.score_test(post, more, kind, covariates=("one",))) == pytest.approx(lrt(A.score_test(post, y, kind)), abs=0.04)


def test_score_test_with_covariates(spark):
    rng = np.random.default_rng(8)
    n = 120
    g, c = rng.integers(0, 3, (4, n)), rng.standard_normal(n)
    rows = [(1, p, i, *map(float, np.eye(3)[g[p, i]])) for p in range(4) for i in range(n) if p or i % 5]
    post = spark.createDataFrame(rows, "chr int, pos int, sample int, p0 double, p1 double, p2 double")
    for kind in ("normal", "binary", "poisson"):
        eta = 0.5 * c + 0.2 * g[1]
        y = eta + rng.standard_normal(n) if kind == "normal" else (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if kind == "binary" else rng.poisson(np.exp(eta)).astype(float)
        people = spark.createDataFrame([(i, float(y[i]), float(c[i])) for i in range(n)] + [(999, None, 1.0)], "sample int, y double, c double")
        got = {r["pos"]: r for r in A.score_test(post, people, kind, covariates=("c",), dispersion=False).collect()}
        for p in range(4):
            own = np.array([i for i in range(n) if p or i % 5])
            z, e, t = np.column_stack([np.ones(len(own)), c[own]]), g[p, own].astype(float), y[own]
            if kind == "normal":
                mu = z @ np.linalg.lstsq(z, t, rcond=None)[0]
                phi, v = ((t - mu) ** 2).sum() / (len(own) - 2), np.ones(len(own))
            else:
                b, _, _ = A.fit_glm(z, t, "logistic" if kind == "binary" else "poisson")
                mu = 1 / (1 + np.exp(-z @ b)) if kind == "binary" else np.exp(z @ b)
                phi, v = 1.0, mu * (1 - mu) if kind == "binary" else mu
            # hard genotypes: the information is that of weighted least squares
            left = e - z @ np.linalg.lstsq(z * np.sqrt(v)[:, None], e * np.sqrt(v), rcond=None)[0]
            want = (e @ (t - mu) / phi) ** 2 / ((v * left * left).sum() / phi)
            assert got[p]["lrt"] == pytest.approx(want, rel=1e-5) and got[p]["n"] == len(own)
