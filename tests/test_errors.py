import numpy as np
import pytest

from lociforge.operators import counting as C
from lociforge.operators import errors as X
from lociforge.operators import pairs as P
from lociforge.operators import quality as Q
from lociforge.operators import spectrum as S


def test_error_rates_of_a_simulated_sample(spark):
    rng = np.random.default_rng(1)
    e = np.array([[0.97, 0.01, 0.01, 0.01], [0.002, 0.99, 0.004, 0.004], [0.03, 0.0, 0.97, 0.0], [0.005, 0.005, 0.005, 0.985]])
    anc = rng.integers(0, 4, 400_000)
    derived = rng.random(len(anc)) < 0.02
    perfect = np.where(derived, (anc + rng.integers(1, 4, len(anc))) % 4, anc)
    own = np.where(rng.random(len(anc)) < 0.02, (anc + rng.integers(1, 4, len(anc))) % 4, anc)
    seen = (rng.random(len(anc))[:, None] > np.cumsum(e[own], axis=1)).sum(axis=1).clip(0, 3)
    keys, n = np.unique(np.stack([anc, perfect, seen], axis=1), axis=0, return_counts=True)
    df = spark.createDataFrame([(7, *map(int, k), int(m)) for k, m in zip(keys, n)] + [(7, 4, 0, 0, 5), (7, 0, None, 0, 5)], "sample int, anc int, ref int, base int, n int")
    got = np.zeros((4, 4))
    for r in X.ancestral_error_rates(df).collect():
        got[r["true_base"], r["seen_base"]] = r["rate"]
    assert np.allclose(got, e, atol=0.004)
    assert X.overall_error(df).first()["rate"] == pytest.approx(1 - np.diag(e).mean(), abs=0.004)
    assert X.ancestral_error_rates(df.limit(0)).count() == 0


def test_correction_undoes_errors(spark):
    rng = np.random.default_rng(2)
    rows, plain = [], []
    e = {p: np.full((4, 4), 0.02 * (p + 1)) + np.eye(4) * (1 - 0.08 * (p + 1)) for p in range(4)}
    for pos in range(60):
        for p in range(4):
            f = rng.dirichlet(np.ones(4) * 0.3)
            plain.append((1, pos, p, *map(float, f)))
            rows.append((1, pos, p, *map(float, f @ e[p])))
    spec = "chr int, pos int, pop int, f0 double, f1 double, f2 double, f3 double"
    combos = [(0, 1, 2, 3), (1, 0, 2, 3)]
    want = X.pattern_sums(X.pattern_table(spark.createDataFrame(plain, spec), combos, 25)).collect()
    got = X.pattern_sums(X.corrected_patterns(X.pattern_table(spark.createDataFrame(rows, spec), combos, 25), e)).collect()
    key = lambda r: (r["block"], r["h1"])
    for a, b in zip(sorted(want, key=key), sorted(got, key=key)):
        assert np.allclose(a["patterns"], b["patterns"], atol=1e-8) and a["n_sites"] == b["n_sites"]
    sums = P.abba_baba_populations(spark.createDataFrame(plain, spec), combos, 25).collect()
    for r in sums:
        own = next(x for x in want if (x["block"], x["h1"], x["h2"]) == (r["block"], r["h1"], r["h2"]))
        assert own["n_abba"] - own["n_baba"] == pytest.approx(r["numer"]) and own["n_abba"] + own["n_baba"] == pytest.approx(r["denom"])
    assert X.pattern_sums(X.pattern_table(spark.createDataFrame(plain, spec), combos, 25), True).first()["n_abba"] < want[0]["n_abba"] + 1


def test_index_of_a_spectrum():
    x = np.zeros((5, 7))
    x[4, 0] = 3
    x[0, 0] = 100
    assert S.fst_from_spectrum(x, 4, 6) == pytest.approx((1, 1))
    x[2, 3] = 5
    a, b = S.fst_coefficients(4, 6)
    u, w = S.fst_from_spectrum(x, 4, 6)
    k, m = 4 * 7, 2 * 7 + 3
    assert w == pytest.approx((3 * a[k] + 5 * a[m]) / (3 * b[k] + 5 * b[m])) and u == pytest.approx((3 * a[k] / b[k] + 5 * a[m] / b[m]) / 8)


def test_filters_and_draws(spark):
    rows = [(1, p, s, (p + k) % 4, 10 + k, 40, 5, 20, False, p % 4, p % 4, 100 * p + 10 * s + k) for p in range(30) for s in range(2) for k in range(6)]
    reads = spark.createDataFrame(rows, "chr int, pos int, sample int, base int, qs int, mapq int, posi int, isop int, is_rev boolean, ref int, anc int, ord int")
    cut = spark.createDataFrame([(b, 12, s) for b, s in zip(range(4), (0.0, 1.0, 0.5, 0.5))], "base int, min_q int, share double")
    total = lambda r: r["n_a"] + r["n_c"] + r["n_g"] + r["n_t"]
    got = {r["pos"]: r for r in C.thinned_counts(reads, cut).collect()}
    for p in range(30):
        assert 4 <= total(got[p]) <= 6  # two bases of each sample are above the cutoff, one at it
    again = {r["pos"]: total(r) for r in C.thinned_counts(reads.repartition(5), cut).collect()}
    assert again == {p: total(r) for p, r in got.items()}
    one = C.ancestral_errors(reads, "random").where("chr is null").agg({"n": "sum"}).first()[0]
    assert one == 60
    stats = spark.createDataFrame([(1, 1, 0.5, 0.5, 1.0, 0.1), (1, 2, 1e-9, 0.5, 1.0, 0.1), (1, 3, None, None, -9.0, 0.1), (1, 4, None, 1e-9, None, 5.0)], "chr int, pos int, sb3_p double, het_bias_p double, z_qs double, sb1 double").selectExpr("*", "z_qs as z_mapq", "0.0 as z_edge")
    assert [r["pos"] for r in Q.statistic_filter(stats, 1e-4, 1e-4, 5, 2).collect()] == [1]
    assert Q.statistic_filter(stats).count() == 4
