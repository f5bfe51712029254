"""Error rates from an outgroup, and D-statistics corrected for them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.estimators import _lists

#: Patterns of four bases in which the second and third population share a base that the first and the outgroup haven't, the first and the third, and
#: the first and the second; by base codes, most significant first.
ABBA = [(a, b, b, a) for a in range(4) for b in range(4) if a != b]
BABA = [(b, a, b, a) for a in range(4) for b in range(4) if a != b]
BBAA = [(b, b, a, a) for a in range(4) for b in range(4) if a != b]


def best_errors(seen: np.ndarray, truth: np.ndarray, rounds: int = 20000, tol: float = 1e-10) -> np.ndarray:
    """Error rates (4 x 4, row true base) that best explain counts of (ancestral, observed) bases if true bases are distributed as those of an
    error-free genome, counts ``truth`` of (ancestral, true) bases: maximum likelihood by EM over the unknown true base."""
    p = truth / np.maximum(truth.sum(axis=1, keepdims=True), 1e-300)
    e = np.full((4, 4), 0.01) + np.eye(4) * 0.96
    for _ in range(rounds):
        share = seen / np.maximum(p @ e, 1e-300)
        new = e * (p.T @ share)
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        done = np.abs(new - e).max() < tol
        e = new
        if done:
            break
    return e


def ancestral_error_rates(counts: DataFrame) -> DataFrame:
    """``sample, true_base, seen_base, rate`` from counts ``sample, anc, ref, base, n`` (ref: an error-free genome's base); N is left out.

    A sample's counts are at most 64 numbers, so each sample is one small problem.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((4, 4, 4))
        np.add.at(m, (pdf["anc"].to_numpy(), pdf["ref"].to_numpy(), pdf["base"].to_numpy()), pdf["n"].to_numpy())
        e = best_errors(m.sum(axis=1), m.sum(axis=2))
        i, j = np.indices((4, 4))
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "true_base": i.ravel().astype("int32"), "seen_base": j.ravel().astype("int32"), "rate": e.ravel()})

    ok = counts.where("anc between 0 and 3 and ref between 0 and 3 and base between 0 and 3").groupBy("sample", "anc", "ref", "base").agg(F.sum("n").alias("n"))
    return ok.groupBy("sample").applyInPandas(run, f"sample {dict(counts.dtypes)['sample']}, true_base int, seen_base int, rate double")


def overall_error(counts: DataFrame) -> DataFrame:
    """``sample, rate``: the excess of derived bases over those of the error-free genome, relative to the ancestral ones."""
    n, derived, other = F.col("n"), F.col("anc") != F.col("base"), F.col("anc") != F.col("ref")
    ok = counts.where("anc between 0 and 3 and ref between 0 and 3 and base between 0 and 3").groupBy("sample")
    g = ok.agg(F.sum(F.when(derived, n).otherwise(0)).alias("x"), F.sum(F.when(other, n).otherwise(0)).alias("p"), F.sum(F.when(~other, n).otherwise(0)).alias("same"))
    return g.select("sample", ((F.col("x") - F.col("p")) / F.nullif((F.col("same") - F.col("p")).cast("double"), F.lit(0.0))).alias("rate"))


def pattern_table(freqs: DataFrame, combos: list[tuple[int, int, int, int]], block: int = 5_000_000) -> DataFrame:
    """``chr, block, h1, h2, h3, h4, n_sites, patterns``: expected numbers of all 256 patterns of four bases in each block, from the base shares
    of populations (chr, pos, pop, f0 ... f3).  Tasks add up the patterns of the blocks they see."""
    pops = sorted({p for c in combos for p in c})
    packed = F.map_from_entries(F.collect_list(F.struct(F.col("pop").cast("int"), F.array("f0", "f1", "f2", "f3"))))
    none = F.array_repeat(F.lit(float("nan")), 4)
    g = freqs.where(F.col("pop").isin(pops)).groupBy("chr", "pos").agg(packed.alias("m"))
    g = g.select("chr", F.floor((F.col("pos") + 1) / block).alias("block"), F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(p)), none) for p in pops))).alias("f"))
    at = np.array([[pops.index(p) for p in c] for c in combos])
    names = ["chr", "block", "combo", "n_sites", "patterns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray(b["f"].flatten(), dtype=np.float64).reshape(b.num_rows, len(pops), 4)
            where = np.stack([np.asarray(b["chr"]), np.asarray(b["block"])], axis=1)
            for key in np.unique(where, axis=0):
                rows = np.flatnonzero((where == key).all(axis=1))
                own = f[rows]
                sums, n = np.zeros((len(at), 256)), np.zeros(len(at), np.int64)
                for k, c in enumerate(at):
                    q = own[:, c]
                    q = q[~np.isnan(q).any(axis=(1, 2))]
                    n[k] = len(q)
                    sums[k] = np.einsum("na,nb,nc,nd->abcd", *(q[:, i] for i in range(4)), optimize=True).ravel()
                first = pa.array(np.full(len(at), rows[0]))
                yield pa.RecordBatch.from_arrays([b["chr"].take(first), b["block"].take(first), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(n), _lists(sums)], names)

    t = dict(g.dtypes)
    parts = g.mapInArrow(run, f"chr {t['chr']}, block {t['block']}, combo int, n_sites bigint, patterns array<double>")
    each = parts.select("chr", "block", "combo", "n_sites", F.posexplode("patterns").alias("k", "v")).groupBy("chr", "block", "combo", "k").agg(F.sum("v").alias("v"), F.sum("n_sites").alias("n_sites"))
    rows = each.groupBy("chr", "block", "combo").agg(F.max("n_sites").alias("n_sites"), F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("patterns"))
    h = [F.get(F.array(*(F.lit(int(c[i])) for c in combos)), F.col("combo")).alias(f"h{i + 1}") for i in range(4)]
    return rows.where("n_sites > 0").select("chr", "block", *h, "n_sites", "patterns")


def corrected_patterns(patterns: DataFrame, errors: dict[int, np.ndarray]) -> DataFrame:
    """The same table with the patterns that would be seen without errors: each population's error matrix (row true base) is inverted.

    Corrected counts can be slightly negative.  Populations without a matrix have no errors.
    """
    names = ["chr", "block", "h1", "h2", "h3", "h4", "n_sites", "patterns"]
    inverse = {p: np.linalg.inv(e.T) for p, e in errors.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array(b["patterns"].flatten(), dtype=np.float64).reshape(b.num_rows, 4, 4, 4, 4)
            for row, pops in enumerate(zip(*(b[f"h{i + 1}"].to_pylist() for i in range(4)))):
                out[row] = np.einsum("abcd,ea,fb,gc,hd->efgh", out[row], *(inverse.get(p, np.eye(4)) for p in pops), optimize=True)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names[:-1]), _lists(out.reshape(b.num_rows, 256))], names)

    return patterns.select(*names).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.select(*names).schema))


def pattern_sums(patterns: DataFrame, drop_transitions: bool = False) -> DataFrame:
    """Adds ``n_abba, n_baba, n_bbaa`` of each block, all patterns or those of bases that differ by a transversion."""

    def total(kinds: list[tuple]) -> list[int]:
        kept = [k for k in kinds if not (drop_transitions and abs(max(k) - min(k)) == 2)]
        return [reduce(lambda x, y: 4 * x + y, k) for k in kept]

    add = lambda kinds: reduce(lambda a, b: a + b, [F.get("patterns", F.lit(i)) for i in total(kinds)])
    return patterns.withColumns({"n_abba": add(ABBA), "n_baba": add(BABA), "n_bbaa": add(BBAA)})
