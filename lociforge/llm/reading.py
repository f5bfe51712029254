"""Reading level of documents by regularised ordinal regression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.words import INVISIBLE, Buckets, summed

#: Hashed vocabulary of the corpus-wide word counts: the table that is broadcast has this size at any scale.
FEATURES = 1 << 18
#: Labelled documents used for the fit at most, the ones with the smallest hash of their id.
SAMPLE = 20_000
#: Least number of graded texts for a calibration.
CALIBRATED = 200
#: Levels, and the strength of the ridge penalty.
LEVELS, RIDGE = (1, 2, 3, 4, 5), 1e-3
# Function words that tell the languages apart, plain and subordinating or formal connectives, relative words.
FUNCTION = {
    "en": "the a an of and is are there with from to in it that",
    "de": "der die das ein eine und ist es gibt mit von den dem nicht",
    "fr": "le la les un une et est il y a avec de du des",
    "es": "el la los las un una y es hay con de del en se",
}
PLAIN = {
    "en": "and or but then so because when", "de": "und oder aber dann denn weil wenn",
    "fr": "et ou mais puis car parce quand", "es": "y o pero luego porque cuando entonces",
}
FORMAL = {
    "en": "although whereas insofar inasmuch provided notwithstanding nevertheless consequently moreover furthermore hence therefore thereby unless albeit despite",
    "de": "obwohl obgleich wohingegen während insofern insoweit sofern vorausgesetzt ungeachtet nichtsdestoweniger dennoch folglich infolgedessen überdies ferner daher mithin gleichwohl",
    "fr": "bien quoique tandis alors dans pourvu nonobstant néanmoins toutefois conséquent moyennant outre ainsi dès attendu lorsque puisque",
    "es": "aunque mientras medida cuanto siempre obstante embargo consiguiente consecuencia además asimismo dado puesto pese salvo",
}
RELATIVE = {"en": "which whose whom who", "de": "welche welcher welches welchen welchem deren dessen", "fr": "qui que lequel laquelle dont", "es": "que cual cuyo cuya quien"}
_LANGS = len(FUNCTION)
#: The cells of a (list, language) table that a word counts for.
_CELLS: dict[str, list[int]] = {}
for _i, _x in enumerate((FUNCTION, PLAIN, FORMAL, RELATIVE)):
    for _j, _lang in enumerate(FUNCTION):
        for _w in set(_x[_lang].split()):
            _CELLS.setdefault(_w, []).append(_i * _LANGS + _j)
_MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#\d{1,7};")
_STARTS = "|".join(sorted({w.title() for x in FUNCTION.values() for w in x.split()}))
#: Sentences end at a mark or line break; where the marks are lost, before a capitalised function word.
_SENTENCE = re.compile(rf"[.!?]+(?:\s|$)|[\n\r]+|\s+(?=(?:(?:{_STARTS})\s|[LD]['’]))")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Edges of the rarity classes, in log10 of a word's share of all corpus words, and of the length classes.
RARITY = np.array([-5.5, -5.0, -4.5, -4.0, -3.5, -3.0, -2.5])
LENGTH = np.array([5, 8, 11, 14])


def clean(text: str) -> str:
    """Text without invisible characters and markup; line breaks written as tags become line breaks."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub("\n", text)
    return text if text.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", text))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def features(text: str, bucket: Buckets, logshare: np.ndarray) -> np.ndarray | None:
    """The feature vector of one text, None without any word."""
    text = clean(text)
    parts = [x for s in _SENTENCE.split(text) if (x := tokens(s))]
    ws = [w for x in parts for w in x]
    n = len(ws)
    if not n:
        return None
    sentences = [len(x) for x in parts]
    n_s = len(sentences)
    length = np.fromiter(map(len, ws), np.float64, n)
    rare = logshare[bucket(ws)].astype(np.float64)
    long_mean, rare_mean = float(length.sum()) / n, float(rare.sum()) / n
    kinds = np.bincount(np.searchsorted(RARITY, rare) * (len(LENGTH) + 1) + np.searchsorted(LENGTH, length, side="right"), minlength=(len(RARITY) + 1) * (len(LENGTH) + 1)) / n
    table = np.bincount([i for w in ws if w in _CELLS for i in _CELLS[w]], minlength=4 * _LANGS).reshape(4, _LANGS)
    known = table[0].any()  # a text without function words of these languages has no language: all their signs count
    lang = int(np.argmax(table[0]))
    signs = (table[1:, lang] if known else table[1:].max(axis=1)).astype(np.float64)
    commas, semis = text.count(","), text.count(";")
    clauses = (commas + semis + signs[1]) / n_s
    base = [
        np.log(n), np.log(n / n_s), np.log(max(sentences)), long_mean, rare_mean, np.sqrt(max(float(rare @ rare) / n - rare_mean**2, 0.0)), len(set(ws)) / np.sqrt(n), len(set(ws)) / n,
        commas / n_s, semis / n_s, np.log1p(clauses), *(signs / n_s), *(signs / n), np.log1p(signs[1]), np.count_nonzero(length >= 9) / n, np.count_nonzero(length >= 12) / n,
    ]
    one = np.zeros(len(FUNCTION))
    one[lang] = known
    base = np.array(base)
    # a language's own slope for the length features, whose scale differs between languages
    own = np.outer(one, [long_mean, np.log(n / n_s), np.count_nonzero(length >= 9) / n, rare_mean]).ravel()
    return np.concatenate([base, kinds, one, own])


@dataclass
class Ordinal:
    """A proportional-odds model: P(level > k) = sigmoid(x w - cut_k) for standardised x."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def calibrated(self, scores: np.ndarray, level: np.ndarray) -> Ordinal:
        """The model with its score stretched and its cuts moved to fit graded texts whose scores come from fits without them."""
        m = fit_ordinal(scores[:, None], level, 0.0, steady=1e-3)
        factor = float(m.weights[0] / m.scale[0])
        if not np.isfinite(factor) or factor <= 0:
            return self
        return Ordinal(self.mean, self.scale, self.weights * factor, m.cuts + factor * float(m.mean[0]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(level) for each row and level."""
        above = _sigmoid(self.score(x)[:, None] - self.cuts)
        above = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        return above[:, :-1] - above[:, 1:]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, level: np.ndarray, ridge: float = RIDGE, rounds: int = 60, error: float = 0.02, steady: float = 2.0) -> Ordinal:
    """Maximum penalised likelihood by damped Fisher scoring on the stacked threshold problems.

    Every level boundary is one binary problem with common weights and its own cut.  Raters err now and then: observations are
    weighted down by the chance (``error``) that a label so unlikely is a slip, which bounds any single label's influence.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = np.inf  # a constant column carries nothing
    z = (x - mean) / scale
    k = len(LEVELS) - 1
    above = (level[:, None] > np.array(LEVELS[:-1])).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    w, c = np.zeros(z.shape[1]), -np.log(share / (1 - share))
    pen = ridge * len(z) * k + steady  # the constant steadies the fit to a few hundred labels

    def loss(w: np.ndarray, c: np.ndarray) -> float:
        p = np.clip(_sigmoid((z @ w)[:, None] - c), 1e-12, 1 - 1e-12)
        lik = np.where(above > 0, p, 1 - p)
        return float(-np.log((1 - error) * lik + error / 2).sum() + 0.5 * pen * (w @ w))

    now = loss(w, c)
    for _ in range(rounds):
        p = _sigmoid((z @ w)[:, None] - c)
        lik = np.where(above > 0, p, 1 - p)
        trust = (1 - error) * lik / ((1 - error) * lik + error / 2)
        g = trust * (above - p)
        h = np.maximum(trust * p * (1 - p), 1e-9)
        a = np.zeros((len(w) + k, len(w) + k))
        a[: len(w), : len(w)] = (z * h.sum(axis=1)[:, None]).T @ z + pen * np.eye(len(w))
        a[: len(w), len(w) :] = -z.T @ h
        a[len(w) :, : len(w)] = a[: len(w), len(w) :].T
        a[len(w) :, len(w) :] = np.diag(h.sum(axis=0)) + 1e-6 * np.eye(k)
        step = np.linalg.solve(a, np.r_[z.T @ g.sum(axis=1) - pen * w, -g.sum(axis=0)])
        size = 1.0
        while size > 1e-4:
            nw, nc = w + size * step[: len(w)], c + size * step[len(w) :]
            if (then := loss(nw, nc)) < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-7 * abs(now)
        w, c, now = nw, nc, then
        if done:
            break
    return Ordinal(mean, scale, w, np.sort(c))


def word_shares(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log10 share of each hashed word among all words of all documents, from one distributed count."""

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        bucket = Buckets(FEATURES)
        for b in batches:
            flat = [i for t in b.column(0).to_pylist() if t for i in bucket(tokens(clean(t)))]
            total[:, 0] += np.bincount(flat, minlength=FEATURES) if flat else 0

    counts = summed(docs.select(text), fill, (FEATURES, 1), block=8192)[:, 0]
    return np.log10((counts + 0.5) / max(counts.sum(), 1)).astype(np.float32)


def _mean_level(labels: DataFrame) -> DataFrame:
    """One level a document: the mean of its raters' levels (each label counts in the fit through rounding to the nearest)."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(LEVELS[0], LEVELS[-1]))
    return good.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("reading_level").alias("level"))


def fit(docs: DataFrame, labels: DataFrame, logshare: np.ndarray, sample: int = SAMPLE) -> Ordinal | None:
    """The model from at most ``sample`` labelled documents (those whose id has the smallest hash); None without labels."""
    graded = _mean_level(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(graded, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(logshare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(FEATURES)
        for b in batches:
            out = [(d, lv, x.tobytes()) for d, t, lv in zip(*(c.to_pylist() for c in b.columns)) if (x := features(t, bucket, shared.value)) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), [pa.int64(), pa.float64(), pa.binary()])], ["doc_id", "level", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, level double, x binary").orderBy("doc_id").toArrow()
    if got.num_rows < 20 or len(set(got["level"].to_pylist())) < 2:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist())).reshape(got.num_rows, -1)
    return fit_calibrated(x, np.asarray(got["level"]), np.asarray(got["doc_id"]))


def fit_calibrated(x: np.ndarray, level: np.ndarray, ids: np.ndarray, least: int = CALIBRATED, folds: int = 5) -> Ordinal:
    """The fit to all graded texts, calibrated where there are at least ``least``: each fifth (by a hash of the id) is scored by a fit to the other
    four, and these held-out scores say how far the model's score is to be stretched and where its cuts lie."""
    model = fit_ordinal(x, level)
    if len(x) < least:
        return model
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(folds)
    scores = np.empty(len(x))
    for k in range(folds):
        out = fold == k
        if len(np.unique(level[~out])) < 2:
            return model
        part = fit_ordinal(x[~out], level[~out])
        scores[out] = part.score(x[out]) - part.score(x).mean() + model.score(x).mean()  # cuts are relative to the mean score
    return model.calibrated(scores, level)


def calibration_error(model: Ordinal, x: np.ndarray, level: np.ndarray, above: int = 3, bins: int = 10) -> float:
    """Expected calibration error of P(level > above): the mean gap between forecast and observed share over bins of the forecast."""
    p = model.probabilities(x)[:, above:].sum(axis=1)
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[at == k].sum() - (level[at == k] > above).sum()) for k in range(bins)) / max(len(p), 1))


def reading_levels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, reading_level, expected_level, demanding``: level 1 (first reader) to 5 (specialist) of every document.

    ``reading_level`` is the median level under the model, ``expected_level`` the mean, ``demanding`` the probability of level 4 or 5.
    Null texts and texts without a word get nulls.  Texts are read whole; the language tag isn't used.
    Connectives and clause words are known in English, German, French and Spanish, the language being the one with most function words; a text without any
    of these is judged by rarity, diversity and lengths, and by such connectives as it shares with one of them.  A document with
    several labels counts once, with their mean; null levels and levels outside 1-5 don't count; other columns are ignored; repeated
    documents all get their level.  With fewer than 20 labelled documents there is no model and all levels are null.

    Word counts cover the whole corpus (one distributed pass into a table of fixed size), the regression is fitted on the
    driver to a bounded sample of labelled documents and calibrated on scores that each fifth of it gets from the rest, and a second pass scores every document.  Nothing is shuffled.
    """
    logshare = word_shares(docs)
    model = fit(docs, labels, logshare, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, logshare))
    names = ["doc_id", "reading_level", "expected_level", "demanding"]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logshare = shared.value
        bucket = Buckets(FEATURES)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            xs = [features(t, bucket, logshare) if t and model else None for t in texts]
            there = np.array([x is not None for x in xs])
            level, mean, high = np.zeros(len(xs), np.int32), np.zeros(len(xs)), np.zeros(len(xs))
            if there.any():
                p = model.probabilities(np.array([x for x in xs if x is not None]))
                level[there] = np.argmax(np.cumsum(p, axis=1) >= 0.5, axis=1) + LEVELS[0]
                mean[there] = p @ np.array(LEVELS)
                high[there] = p[:, 3:].sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, ty, mask=~there) for v, ty in zip((level, mean, high), types[1:]))], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, reading_level int, expected_level double, demanding double")


def demanding(levels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents more likely than not written at level 4 or 5."""
    return levels.where("demanding >= 0.5").select("doc_id")
