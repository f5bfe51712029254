"""Coalescence times along contigs from windows with and without heterozygous sites, and the population sizes behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.iterative import total_of
from lociforge.session import cut

#: Windows of one piece of a chain: pieces are worked on in parallel and exchange their messages, nothing is forgotten at their borders.
PIECE = 4096
#: Pieces that a kernel works on at a time.
TOGETHER = 16


def time_grid(states: int, longest: float = 15.0) -> np.ndarray:
    """Boundaries of coalescence-time intervals, in units of twice the population size, denser near the present."""
    return 0.1 * (np.exp(np.arange(states + 1) / states * np.log(1 + 10 * longest)) - 1)


def hidden_markov(states: int, theta: float, rho: float, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stationary distribution, transition matrix and chance of a heterozygous window of each state.

    With piecewise constant sizes the chance of a first coalescence in an interval follows from the hazard 1 / size; a recombination
    (rate rho per window and unit of time) draws a new time from the same distribution, otherwise the time stays.
    """
    edges = time_grid(states)
    lam = np.ones(states) if sizes is None else np.asarray(sizes, float)
    width = np.diff(edges)
    hazard = width / lam
    alive = np.exp(-np.r_[0, np.cumsum(hazard)])
    stationary = alive[:-1] - alive[1:]
    stationary[-1] += alive[-1]
    middle = (edges[:-1] + edges[1:]) / 2
    moved = 1 - np.exp(-rho * middle)
    trans = moved[:, None] * stationary[None, :] + np.diag(1 - moved)
    return stationary, trans, 1 - np.exp(-theta * middle)


def _emissions(obs: np.ndarray, het: np.ndarray) -> np.ndarray:
    return np.where(obs[..., None] == 1, het, np.where(obs[..., None] == 0, 1 - het, 1.0))


def transfer(obs: np.ndarray, heads: np.ndarray, trans: np.ndarray, het: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (rows of obs) the matrix that takes the message before it to the one behind it, and the log of its scale.

    ``heads`` is the place of a chain's first window in the piece, -1 for later pieces: before the head nothing happens, and it has no
    transition.
    """
    p, width = obs.shape
    emit = _emissions(obs, het)
    m = np.tile(np.eye(len(het)), (p, 1, 1))
    log = np.zeros(p)
    for t in range(width):
        moved = m @ trans
        if (heads >= t).any():
            moved = np.where((heads == t)[:, None, None], m, moved)
            moved = moved * emit[:, t, None, :]
            m = np.where((heads > t)[:, None, None], m, moved)
        else:
            m = moved * emit[:, t, None, :]
        top = m.max(axis=(1, 2))
        m /= top[:, None, None]
        log += np.log(top)
    return m, log


def posterior(obs: np.ndarray, heads: np.ndarray, alpha: np.ndarray, beta: np.ndarray, trans: np.ndarray, het: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (pieces x windows x states) and expected transitions (states x states, summed over the pieces), given the messages
    before and behind each piece."""
    p, width = obs.shape
    emit = _emissions(obs, het)
    f = np.empty((p, width, len(het)))
    now = alpha / alpha.sum(axis=1, keepdims=True)
    before = now
    for t in range(width):
        moved = now @ trans
        if (heads >= t).any():
            moved = np.where((heads == t)[:, None], now, moved) * emit[:, t]
            now = np.where((heads > t)[:, None], now, moved)
        else:
            now = moved * emit[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        f[:, t] = now
    b = beta / beta.max(axis=1, keepdims=True)
    jumps = np.zeros_like(trans)
    for t in range(width - 1, -1, -1):
        behind = emit[:, t] * b
        left = f[:, t - 1] if t else before
        live = heads < t  # a transition leads into this window
        s = ((left @ trans) * behind).sum(axis=1)
        w = np.where(live, 1 / np.maximum(s, 1e-300), 0.0)
        jumps += (left * w[:, None]).T @ behind
        f[:, t] *= b
        b = np.where(live[:, None], behind @ trans.T, behind)
        b = b / b.max(axis=1, keepdims=True)
    return f / f.sum(axis=2, keepdims=True), jumps * trans


def forward_backward(obs: np.ndarray, start: np.ndarray, trans: np.ndarray, het: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior of the states of each window of one chain and the log likelihood; -1 is a window without data."""
    heads, one = np.zeros(1, int), obs[None, :]
    m, log = transfer(one, heads, trans, het)
    post, _ = posterior(one, heads, start[None, :], np.ones((1, len(het))), trans, het)
    return post[0], float(np.log((start @ m[0]).sum()) + log[0])


def _pieces(windows: DataFrame, by: list[str], piece: int) -> DataFrame:
    """``by..., piece, head, wins, hets``: the observed windows of each piece; head is the place of the chain's first window in its piece, else -1."""
    w = windows.select(*by, F.col("win").cast("bigint").alias("win"), F.col("is_het").cast("int").alias("h"))
    g = w.groupBy(*by, F.floor(F.col("win") / piece).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("win", "h"))).alias("r"))
    first = w.groupBy(*by).agg(F.min("win").alias("__first"))
    g = g.join(first, by)
    head = F.when(F.floor(F.col("__first") / piece) == F.col("piece"), F.col("__first") - F.col("piece") * piece).otherwise(-1)
    return g.select(*by, "piece", head.cast("int").alias("head"), F.col("r.win").alias("wins"), F.col("r.h").alias("hets"))


def _observed(b: pa.RecordBatch, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces x windows) observations, heads, and the row and place of each observed window."""
    sizes = np.diff(np.asarray(b["wins"].offsets))
    row = np.repeat(np.arange(b.num_rows), sizes)
    place = np.asarray(b["wins"].flatten()) - np.asarray(b["piece"])[row] * piece
    obs = np.full((b.num_rows, piece), -1, np.int8)
    obs[row, place] = np.asarray(b["hets"].flatten())
    return obs, np.asarray(b["head"]), row, place


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, TOGETHER):
            yield pa.RecordBatch.from_pylist(b.slice(lo, TOGETHER).to_pylist(), schema=b.schema)  # with offsets from zero


def _messages(pieces: DataFrame, by: list[str], start: np.ndarray, trans: np.ndarray, het: np.ndarray, piece: int) -> DataFrame:
    """``by..., piece, alpha, beta, lik``: the messages before and behind each piece; lik is the chain's log likelihood at its first piece, else null.

    Each piece becomes one matrix of states x states, in parallel; a chain's matrices (600 for the longest human contig) are multiplied through
    in one task.  Pieces without any window count through powers of the transition matrix.
    """
    types = dict(pieces.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            obs, heads, _, _ = _observed(b, piece)
            m, log = transfer(obs, heads, trans, het)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in (*by, "piece", "head")), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(log)], [*by, "piece", "head", "m", "log"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece").reset_index(drop=True)
        k = len(start)
        ms = [np.frombuffer(x).reshape(k, k) for x in pdf["m"]]
        gap = np.diff(pdf["piece"].to_numpy(), prepend=pdf["piece"].iloc[0] - 1) - 1
        alpha, lik, a = [], float(pdf["log"].sum()), start
        for m, g in zip(ms, gap):
            if g > 0:
                a = a @ np.linalg.matrix_power(trans, int(g) * piece)
            alpha.append(a / a.sum())
            lik += float(np.log(a.sum()))
            a = (a / a.sum()) @ m
        lik += float(np.log(a.sum()))
        beta, b = [None] * len(ms), np.ones(k)
        for i in range(len(ms) - 1, -1, -1):
            beta[i] = b / b.max()
            b = ms[i] @ beta[i]
            if gap[i] > 0:
                b = np.linalg.matrix_power(trans, int(gap[i]) * piece) @ b
        out = pdf[[*by, "piece"]].copy()
        out["alpha"], out["beta"] = [x.tobytes() for x in alpha], [x.tobytes() for x in beta]
        out["lik"] = [lik] + [None] * (len(ms) - 1)
        return out

    made = pieces.mapInArrow(matrices, f"{keys}, piece bigint, head int, m binary, log double")
    return made.groupBy(*by).applyInPandas(chain, f"{keys}, piece bigint, alpha binary, beta binary, lik double")


def _vectors(col: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist())).reshape(-1, k)


def decode(windows: DataFrame, states: int = 20, theta: float = 0.1, rho: float = 0.02, sizes: np.ndarray | None = None, by: tuple[str, ...] = ("chr",), piece: int = PIECE) -> DataFrame:
    """``by..., win, state, mean_time`` of windows (by..., win, is_het): the likeliest interval and the expected time.

    The windows of a group, a contig or a sample's contig, form one chain.  Chains are cut into pieces of ``piece`` windows; messages cross
    the borders through the pieces' transfer matrices, so the result doesn't depend on the cuts.
    """
    by = list(by)
    start, trans, het = hidden_markov(states, theta, rho, sizes)
    edges = time_grid(states)
    middle = (edges[:-1] + edges[1:]) / 2
    pieces = cut(_pieces(windows, by, piece))
    joined = pieces.join(_messages(pieces, by, start, trans, het, piece), [*by, "piece"])
    types = dict(windows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            obs, heads, row, place = _observed(b, piece)
            post, _ = posterior(obs, heads, _vectors(b["alpha"], states), _vectors(b["beta"], states), trans, het)
            p = post[row, place]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in by), b["wins"].flatten(), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p @ middle)], [*by, "win", "state", "mean_time"])

    cols = [*by, "piece", "head", "wins", "hets", "alpha", "beta"]
    return joined.select(*cols).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", win bigint, state int, mean_time double")


def fit_sizes(windows: DataFrame, states: int = 20, groups: list[int] | None = None, theta: float = 0.1, rho: float = 0.02, rounds: int = 20, tol: float = 1e-4,
              by: tuple[str, ...] = ("chr",), piece: int = PIECE) -> tuple[np.ndarray, float, float, float]:
    """Relative population size of each time interval, theta and rho per window, and the log likelihood, by expectation maximisation.

    ``groups`` gives the number of consecutive intervals that share one size (4, then pairs by default).  Each round is one distributed pass
    that adds up expected transitions and emissions (states x states numbers); the parameters that fit them best are then
    searched for on the driver, by coordinates in logs.
    """
    by = list(by)
    if groups is None:
        groups = [min(4, states), *[2] * ((states - 4) // 2), *[1] * ((states - 4) % 2)] if states > 4 else [1] * states
    if sum(groups) != states:
        raise ValueError("groups must add up to the number of states")
    x = np.r_[np.zeros(len(groups)), np.log(theta), np.log(rho)]
    model: Callable[[np.ndarray], tuple] = lambda x: hidden_markov(states, np.exp(x[-2]), np.exp(x[-1]), np.repeat(np.exp(x[:-2]), groups))
    pieces = cut(_pieces(windows, by, piece))
    last = -np.inf
    for _ in range(rounds):
        start, trans, het = model(x)
        messages = cut(_messages(pieces, by, start, trans, het, piece))
        lik = float(messages.agg(F.sum("lik")).first()[0] or 0.0)

        def fill(b: pa.RecordBatch, t: np.ndarray, start: np.ndarray = start, trans: np.ndarray = trans, het: np.ndarray = het) -> None:
            for part in _slices(iter([b])):
                obs, heads, row, place = _observed(part, piece)
                post, jumps = posterior(obs, heads, _vectors(part["alpha"], states), _vectors(part["beta"], states), trans, het)
                seen, p = obs[row, place], post[row, place]
                first = np.flatnonzero(heads >= 0)
                t[: states * states] += jumps.ravel()
                t[-3 * states : -2 * states] += post[first, heads[first]].sum(axis=0)
                t[-2 * states : -states] += p[seen == 1].sum(axis=0)
                t[-states:] += p[seen == 0].sum(axis=0)

        joined = pieces.join(messages, [*by, "piece"]).select(*by, "piece", "head", "wins", "hets", "alpha", "beta")
        t = total_of(joined, states * (states + 3), fill)
        jumps, (begin, ones, zeros) = t[: states * states].reshape(states, states), t[states * states :].reshape(3, states)

        def fits(x: np.ndarray, jumps: np.ndarray = jumps, begin: np.ndarray = begin, ones: np.ndarray = ones, zeros: np.ndarray = zeros) -> float:
            start, trans, het = model(x)
            logs = lambda v: np.log(np.maximum(v, 1e-300))
            return float((begin * logs(start)).sum() + (jumps * logs(trans)).sum() + (ones * logs(het)).sum() + (zeros * logs(1 - het)).sum())

        x = _climb(fits, x)
        if abs(lik - last) < tol:
            break
        last = lik
    return np.repeat(np.exp(x[:-2]), groups), float(np.exp(x[-2])), float(np.exp(x[-1])), lik


def _climb(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 0.5, least: float = 1e-3, bound: float = 4.6) -> np.ndarray:
    """Maximum by coordinate steps that halve where none helps; sizes stay within a factor of 100 of 1."""
    x, best = x.copy(), f(x)
    while step > least:
        moved = False
        for i in range(len(x)):
            for d in (step, -step):
                y = x.copy()
                y[i] += d
                if i < len(x) - 2 and abs(y[i]) > bound:
                    continue
                if (v := f(y)) > best + 1e-9:
                    x, best, moved = y, v, True
                    break
        if not moved:
            step /= 2
    return x
