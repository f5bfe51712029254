"""Evaluation passages inside a corpus: latent semantic retrieval, then exact and paraphrase checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.words import Buckets, summed, words

#: Hashed vocabulary, retained dimensions and oversampling of the randomised SVD, and dimensions of the sketch of what it leaves
#: out: what is broadcast has this size at any scale.
FEATURES, RANK, OVER, REST = 1 << 16, 32, 8, 32
#: A run of MIN_RUN common words holds a whole window of WINDOW words that starts at a multiple of MIN_RUN - WINDOW + 1.
MIN_RUN, WINDOW = 10, 5
#: Least cosine of candidates; windows of equal words have cosine 1.
COSINE = 0.95
#: A paraphrase holds so much of the item in order, and so much of its RARE rarest words.
LCS_SHARE, ANSWER_SHARE, RARE = 0.8, 0.6, 5
#: Pairs of a rare word in a document and an item, counted at a time.
RARE_PAIRS = 2_000_000
#: Eval items searched for at once; more items are searched for in blocks of about so many.
ITEM_BLOCK = 5000
_OUT = "doc_id bigint, item_id bigint, run_words int, lcs_share double, answer_share double"


@dataclass
class Latent:
    """The fitted space: vectors of hashed words (idf times right singular vector and sketch of the residual) and the idf itself."""

    vectors: np.ndarray
    idf: np.ndarray


def _batches(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 2_000_000) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, words of each text) in portions of about so many characters; null texts are left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(text_at).to_pylist()):
            if t:
                ids.append(i)
                texts.append(words(t))
                size += len(t)
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def fit(docs: DataFrame, text: str = "text", seed: int = 7) -> Latent:
    """Randomised SVD of the TF-IDF matrix of all passages of all documents, in one distributed pass.

    Passages are consecutive windows of WINDOW words, features are words hashed to FEATURES buckets.  Each task sketches its
    share of A'A against a random test matrix and counts document frequencies; the sums (of fixed size) come to the driver,
    where the idf weights are applied and the sketch is orthogonalised.
    """
    width = RANK + OVER

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        test = np.random.default_rng(seed).standard_normal((FEATURES, width)).astype(np.float32)
        bucket = Buckets(FEATURES)
        for _, texts in _batches(batches, 0):
            flat, starts, doc_ids, at = [], [], [], 0
            for ws in texts:
                ids = bucket(ws)
                flat += ids
                doc_ids += set(ids)
                starts += range(at, at + len(ids), WINDOW)
                at += len(ids)
            if not flat:
                continue
            f, s = np.array(flat), np.array(starts)
            y = np.add.reduceat(test[f], s, axis=0)
            y = np.repeat(y, np.diff(np.r_[s, len(f)]), axis=0)
            order = np.argsort(f, kind="stable")
            f = f[order]
            cuts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            total[f[cuts], 1:] += np.add.reduceat(y[order], cuts, axis=0)
            total[:, 0] += np.bincount(doc_ids, minlength=FEATURES)

    sums = summed(docs.select(text), fill, (FEATURES, width + 1))
    df = sums[:, 0]
    # no feature is in more documents than there are, and the idf needs the number only up to a constant
    idf = np.log((1 + max(df.max(), 1)) / (1 + df)) + 1
    left = np.linalg.svd(sums[:, 1:] * idf[:, None], full_matrices=False)[0][:, :RANK]
    # rare words, names above all, lie almost wholly outside of the leading dimensions: a random sketch of the rest keeps them apart
    test = np.random.default_rng(seed + 1).standard_normal((FEATURES, REST)) / np.sqrt(REST)
    rest = test - left @ (left.T @ test)
    return Latent((idf[:, None] * np.hstack([left, rest])).astype(np.float32), idf.astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)


def _windows(ids: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows that start at ``at``."""
    return _unit(sum(vectors[ids[at + k]] for k in range(WINDOW)))


def _centres(q: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """A few rounds of spherical k-means over the query windows."""
    rng = np.random.default_rng(seed)
    c = q[rng.choice(len(q), min(n, len(q)), replace=False)]
    for _ in range(5):
        near = np.argmax(q @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, q)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel row updates."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def stretch(a: list[str], b: list[str], k: int) -> list[str]:
    """The stretch of document a from half a length of item b before its k-th half length to 2.5 lengths in all."""
    half = max(1, len(b) // 2)
    return a[max(0, (k - 1) * half) : (k + 2) * half + len(b)]


class _Items:
    """The query side: items' words, and their windows' latent vectors in an inverted file around a few centres."""

    def __init__(self, items: list[tuple[int, str]], latent: Latent) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        bucket = Buckets(FEATURES)
        self.item, self.pos, qs, self.rare = [], [], [], []
        for k, ws in enumerate(self.words):
            ids = np.array(bucket(ws), dtype=np.int64)
            self.rare.append({ws[i] for i in np.argsort(-latent.idf[ids], kind="stable")[:RARE]} if len(ids) else set())
            if len(ids) >= WINDOW:
                at = np.arange(len(ids) - WINDOW + 1)
                qs.append(_windows(ids, at, latent.vectors))
                self.item += [k] * len(at)
                self.pos += at.tolist()
        self.empty = not qs
        if self.empty:
            return
        # every rare word's bucket with the items it is rare in: a paraphrase holds at least need of an item's rare words
        self.need = np.array([next(n for n in range(len(r) + 1) if n >= ANSWER_SHARE * len(r) - 1e-9) for r in self.rare])
        marks = [(b, k, n) for k, ws in enumerate(self.words) if len(ws) >= WINDOW for n, b in enumerate(bucket(sorted(self.rare[k])))]
        marks = np.array(sorted(marks), dtype=np.int64).reshape(-1, 3)
        self.mark_item, self.mark_word = marks[:, 1], marks[:, 2]
        self.mark_cuts = np.searchsorted(marks[:, 0], np.arange(FEATURES + 1))
        q = np.vstack(qs).astype(np.float32)
        self.item, self.pos = np.array(self.item), np.array(self.pos)
        self.centres = _centres(q, max(1, min(256, len(q) // 16)))
        # each query window stands in the lists of its two nearest centres, and a corpus window looks into its nearest: equal
        # windows meet even if rounding ranks two centres differently
        s = q @ self.centres.T
        best = s.argmax(axis=1)
        s[np.arange(len(q)), best] = -2
        second = s.argmax(axis=1)
        self.lists = []
        for c in range(len(self.centres)):
            m = np.flatnonzero((best == c) | (second == c))
            self.lists.append((m, q[m]))

    def rare_pairs(self, f: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (document, item) in which so many of the item's rare words occur as a paraphrase needs; f holds the words' buckets,
        doc their documents, in order."""
        n = np.diff(self.mark_cuts)[f]
        f, doc, n = f[n > 0], doc[n > 0], n[n > 0]
        ends, out, lo = np.cumsum(n), [], 0
        while lo < len(f):
            hi = max(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RARE_PAIRS, "right"), lo + 1)
            hi = np.searchsorted(doc, doc[hi - 1], "right")  # documents stay whole
            reps = n[lo:hi]
            mark = np.repeat(self.mark_cuts[f[lo:hi]] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            key = np.unique((np.repeat(doc[lo:hi], reps) * len(self.words) + self.mark_item[mark]) * RARE + self.mark_word[mark]) // RARE
            pair, seen = np.unique(key, return_counts=True)
            d, item = np.divmod(pair, len(self.words))
            m = seen >= self.need[item]
            out += zip(d[m].tolist(), item[m].tolist())
            lo = hi
        return out

    def places(self, a: list[str], item: int) -> set[int]:
        """The stretches of a document that hold enough of the item's rare words, and of its words at all, for a paraphrase."""
        b, rare = self.words[item], self.rare[item]
        half, at = max(1, len(b) // 2), [i for i, w in enumerate(a) if w in rare]
        out = set()
        for k in {k for i in at for k in range(max(0, (i - len(b)) // half - 2), i // half + 2)}:
            x = set(stretch(a, b, k))
            if len(rare & x) >= self.need[item] and sum(w in x for w in b) >= LCS_SHARE * len(b) - 1e-9:
                out.add(k)
        return out

    def candidates(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        near = (x @ self.centres.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.arange(len(self.lists) + 1))
        rows, hits = [], []
        for c, (m, q) in enumerate(self.lists):
            r = order[cuts[c] : cuts[c + 1]]
            if not len(m) or not len(r):
                continue
            for lo in range(0, len(r), 8192):
                a, b = np.nonzero(x[r[lo : lo + 8192]] @ q.T >= cosine)
                rows.append(r[lo + a])
                hits.append(m[b])
        return (np.concatenate(rows), np.concatenate(hits)) if rows else (np.empty(0, int), np.empty(0, int))


def leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, latent: Latent | None = None) -> DataFrame:
    """``doc_id, item_id, run_words, lcs_share, answer_share``: documents with passages of eval items, one row for each pair.

    A pair comes out if the document holds at least MIN_RUN consecutive words of the item (``run_words`` is the longest such run), or
    paraphrases it: words of the item in order (longest common subsequence) make up at least 0.8 of it, and at least 0.6 of
    its rarest words, which carry the answer, occur.  Candidates are pairs of windows with a cosine of at least ``cosine`` in the latent space
    of ``fit``.  Windows of equal words have equal vectors, and every run of MIN_RUN words covers a window of the document
    at the stride used, so the candidate search loses no exact passage.  Paraphrases are also looked up by the items' rarest words,
    enough of which each must hold, so none within a stretch of twice the item's length is lost.

    Null and blank texts hold nothing; texts are read whole; repeated documents all count, repeated items once; items shorter than
    WINDOW words cannot be searched for; other columns are ignored.  Items are the query set: blocks of at most about
    ITEM_BLOCK items are broadcast; the corpus is scanned once for the fit and once for each block, without a shuffle.
    """
    spark = docs.sparkSession
    latent = latent or fit(docs)
    wanted = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    blocks = max(1, -(-wanted.count() // ITEM_BLOCK))
    found = []
    for k in range(blocks):
        block = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        found.append(_search(spark, docs, _Items(block, latent), latent, cosine))
    return reduce(DataFrame.unionByName, found)


def _search(spark: SparkSession, docs: DataFrame, queries: _Items, latent: Latent, cosine: float) -> DataFrame:
    shared = spark.sparkContext.broadcast((queries, latent.vectors))
    stride = MIN_RUN - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, vectors = shared.value
        bucket = Buckets(FEATURES)
        for ids, texts in _batches(batches, 1) if not q.empty else ():
            flat, starts, owner, offset, at = [], [], [], [], 0
            for k, ws in enumerate(texts):
                flat += bucket(ws)
                offset.append(at)
                s = range(0, len(ws) - WINDOW + 1, stride)
                starts += [at + i for i in s]
                owner += [k] * len(s)
                at += len(ws)
            if not starts:
                continue
            f, s, own = np.array(flat), np.array(starts), np.array(owner)
            pairs: dict[tuple[int, int], list] = {}
            for lo in range(0, len(s), 50_000):
                rows, hits = q.candidates(_windows(f, s[lo : lo + 50_000], vectors), cosine)
                for r, h in zip(rows.tolist(), hits.tolist()):
                    d, item, j = int(own[lo + r]), int(q.item[h]), int(q.pos[h])
                    state = pairs.setdefault((d, item), [0, set()])
                    a, b, i = texts[d], q.words[item], int(s[lo + r]) - offset[d]
                    state[1].add((i - j) // max(1, len(b) // 2))
                    if a[i : i + WINDOW] != b[j : j + WINDOW]:
                        continue
                    x, y = 0, WINDOW
                    while i - x > 0 and j - x > 0 and a[i - x - 1] == b[j - x - 1]:
                        x += 1
                    while i + y < len(a) and j + y < len(b) and a[i + y] == b[j + y]:
                        y += 1
                    state[0] = max(state[0], x + y)
            for d, item in q.rare_pairs(f, np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])):
                if places := q.places(texts[d], item):
                    pairs.setdefault((d, item), [0, set()])[1].update(places)
            out = []
            for (d, item), (longest, places) in pairs.items():
                b = q.words[item]
                # the stretches where the item would lie if an alike window is part of it, and those with its rare words
                rare = q.rare[item]
                shares = []
                for k in places:
                    x = stretch(texts[d], b, k)
                    share, answer = lcs(b, x) / len(b), len(rare & set(x)) / max(1, len(rare))
                    shares.append((share >= LCS_SHARE and answer >= ANSWER_SHARE, share, answer))
                alike, share, answer = max(shares)
                if longest >= MIN_RUN or alike:
                    out.append((ids[d], q.ids[item], longest, share, answer))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "item_id", "run_words", "lcs_share", "answer_share"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(run, _OUT)
