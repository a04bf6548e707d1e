"""Toxicity by a bidirectional GRU with attention pooling, trained in numpy.

Inputs of a time step are a word vector (words of the training texts; others
share one) and a character vector (mean over hashed character trigrams).  Two
GRUs read a window of ``WINDOW`` words forwards and backwards, attention pools
their states, and a logistic unit scores the window.  Windows overlap by
a quarter and cover the whole text; a document's logit is the largest of its
windows, turned into a probability by a scale fitted on the training texts.

Training is bounded: at most ``TRAIN_DOCS`` labelled documents (smallest hash
of the id first) of at most ``TRAIN_CHARS`` code points are fitted on the
driver.  Scoring covers every document and every window: ``mapInArrow``
without a shuffle, in slices; a task computes the gate inputs of a word once
(its table is emptied at ``TABLE_WORDS``).  Only the text enters a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ripple.llm.common import slices

# bounds on the labelled rows of the training sample: rows, code points of a text, and windows of a toxic and of
# another text that an epoch of the first kind draws at random
TRAIN_DOCS = 4_000
TRAIN_CHARS = 20_000
TRAIN_WINDOWS = (8, 3)
WINDOW, STRIDE = 40, 30
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 8, 8, 8
TRIGRAMS = 4_096
MIN_DOCS = 3                    # a word of fewer training texts shares the vector of unknown words
EPOCHS, WARM_SHARE, BATCH, RATE = 10, 0.3, 256, 0.01
MIN_STEPS = 600                 # small training sets run more epochs, for this many steps
TABLE_WORDS = 200_000           # distinct words a task keeps gate inputs of
SCORE_WINDOWS = 4_096           # windows of one numpy batch
EDGE = re.compile(r"^\W+|\W+$")


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; one empty window for an empty text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words (with word ends) and where each word's begin."""
    raw = [f"^{w or '_'}$".encode() for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    lengths = np.array([len(x) for x in raw])
    grams = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 40503 % 65521 % TRIGRAMS
    ends = np.cumsum(lengths)
    inside = np.ones(len(grams), bool)                  # without those that run over a word's end
    inside[ends[:-1] - 1] = False
    inside[ends[:-1] - 2] = False
    return grams[inside], np.concatenate([[0], np.cumsum(lengths - 2)])[:-1]


def summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of their gradients."""
    order = np.argsort(rows, kind="stable")
    found, at = np.unique(rows[order], return_index=True)
    return found, np.add.reduceat(grads[order], at, axis=0)


class Model:
    """Parameters, forward pass, gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary                     # word -> row; row 0 is shared by unknown words
        self.p = {
            "word": (0.1 * r.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
            "char": (0.1 * r.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32),
            "w": init(d, 6 * h), "b": np.zeros(6 * h, np.float32),
            "uf": init(h, 3 * h), "ub": init(h, 3 * h),
            "a": init(2 * h, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION, 1),
            "o": init(2 * h, 1), "ob": np.zeros(1, np.float32)}
        self.scale = (1.0, 0.0)

    def inputs(self, words: list[str]):
        """Word and character vectors of distinct words, and what the gradient needs."""
        words = [bare(w) for w in words]
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams, at = trigrams(words)
        n = np.diff(np.append(at, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], at, axis=0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][rows], chars], axis=1), (rows, grams, n)

    def _gru(self, x, u, keep, reverse: bool, trace: bool):
        """States (T, N, H) of gate inputs x(t): (N, 3H); keep is the mask (T, N, 1)."""
        h_dim, steps = HIDDEN, range(len(keep))
        h = np.zeros((keep.shape[1], h_dim), np.float32)
        states, notes = np.empty((len(keep), *h.shape), np.float32), {}
        for t in reversed(steps) if reverse else steps:
            g = x(t)
            hu = h @ u
            zr = sigmoid(g[:, :2 * h_dim] + hu[:, :2 * h_dim])
            z, r = zr[:, :h_dim], zr[:, h_dim:]
            n = np.tanh(g[:, 2 * h_dim:] + r * hu[:, 2 * h_dim:])
            new = n + z * (h - n)
            if trace:
                notes[t] = (h, z, r, n, hu[:, 2 * h_dim:])
            h = np.where(keep[t], new, h) if not keep[t].all() else new
            states[t] = h
        return states, notes

    def forward(self, table, index, trace: bool = False):
        """Logits of windows; ``index`` (N, T) points into ``table`` (gate inputs of words), -1 is padding."""
        p, h3 = self.p, 3 * HIDDEN
        index = index.T
        keep = (index >= 0)[:, :, None]
        at = np.maximum(index, 0)
        sf, nf = self._gru(lambda t: table[at[t], :h3], p["uf"], keep, False, trace)
        sb, nb = self._gru(lambda t: table[at[t], h3:], p["ub"], keep, True, trace)
        s = np.concatenate([sf, sb], axis=2)
        q = np.tanh(s @ p["a"] + p["ab"])
        e = (q @ p["v"])[:, :, 0]
        e = np.where(keep[:, :, 0], e, -1e9)
        e = np.exp(e - e.max(axis=0)) * keep[:, :, 0]
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (alpha[:, :, None] * s).sum(axis=0)
        logit = (pooled @ p["o"])[:, 0] + p["ob"][0]
        return (logit, (keep, at, nf, nb, s, q, alpha, pooled)) if trace else logit

    def gradients(self, words: list[str], index, labels, weights):
        """Loss and gradients of the weighted logistic loss over windows."""
        p, h = self.p, HIDDEN
        x, (rows, grams, n_grams) = self.inputs(words)
        table = x @ p["w"] + p["b"]
        logit, (keep, at, nf, nb, s, q, alpha, pooled) = self.forward(table, index, True)
        y = sigmoid(logit)
        loss = -(weights * (labels * np.log(y + 1e-9) + (1 - labels) * np.log(1 - y + 1e-9))).sum() / weights.sum()
        d = (weights * (y - labels) / weights.sum()).astype(np.float32)[:, None]
        g = {"o": pooled.T @ d, "ob": d.sum(axis=0)}
        d_pool = d @ p["o"].T
        d_alpha = (s * d_pool).sum(axis=2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tna,tn->a", q, d_e)[:, None]
        d_q = d_e[:, :, None] * p["v"][:, 0] * (1 - q * q)
        g["a"], g["ab"] = np.einsum("tnh,tna->ha", s, d_q), d_q.sum(axis=(0, 1))
        d_s = alpha[:, :, None] * d_pool + d_q @ p["a"].T
        d_table = np.zeros_like(table)
        for name, notes, part, reverse in (("uf", nf, 0, False), ("ub", nb, 1, True)):
            u, g_u = p[name], np.zeros_like(p[name])
            back = np.zeros((index.shape[0], h), np.float32)
            steps = range(len(keep))
            for t in steps if reverse else reversed(steps):
                hp, z, r, n, hn = notes[t]
                dh = d_s[t][:, part * h:(part + 1) * h] + back
                live = keep[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (hp - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                gate = np.concatenate([dz, dr, dn], axis=1) * live
                inner = np.concatenate([dz, dr, dn * r], axis=1) * live
                g_u += hp.T @ inner
                back = np.where(live, dh * z + inner @ u.T, dh)
                np.add.at(d_table, (at[t], slice(part * 3 * h, (part + 1) * 3 * h)), gate)
            g[name] = g_u
        g["w"], g["b"] = x.T @ d_table, d_table.sum(axis=0)
        d_x = d_table @ p["w"].T
        g["word"] = summed(rows, d_x[:, :WORD_DIM])
        g["char"] = summed(grams, np.repeat(d_x[:, WORD_DIM:] / n_grams[:, None], n_grams, axis=0))
        return loss, g

    def window_logits(self, texts: list[list[str]], known: "WordTable | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and the text each belongs to."""
        known = known or WordTable(self)
        known.learn(set().union(*texts))
        rows, owner = [], []
        for i, t in enumerate(texts):
            t = known.rows(t)
            for a, b in windows_of(len(t)):
                rows.append(t[a:b])
                owner.append(i)
        out = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), SCORE_WINDOWS):
            out[a:a + SCORE_WINDOWS] = self.forward(known.table, padded(rows[a:a + SCORE_WINDOWS]))
        return out, np.array(owner, np.int64)

    def scores(self, texts: list[str], known: "WordTable | None" = None) -> np.ndarray:
        """Probability of each text: its highest window, scaled."""
        if not texts:
            return np.zeros(0)
        logits, owner = self.window_logits([words_of(t) for t in texts], known)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        return sigmoid(self.scale[0] * best + self.scale[1])


class WordTable:
    """Gate inputs of the distinct words seen so far."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def learn(self, words: set[str]) -> None:
        missing = words.difference(self.place)
        if len(self.place) + len(missing) > TABLE_WORDS:
            self.place, missing = {}, words
        if missing:
            new = self.model.inputs(todo := list(missing))[0] @ self.model.p["w"] + self.model.p["b"]
            n = len(self.place)
            if n + len(todo) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), n + len(todo)), 6 * HIDDEN), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n:n + len(todo)] = new
            self.place.update(zip(todo, range(n, n + len(todo))))

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    """The word without punctuation around it."""
    return EDGE.sub("", word)


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max(1, max(map(len, rows)))), -1, np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Adam:
    """Adam steps; of the word and character tables only the rows with a gradient move."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.v = {k: np.zeros_like(x) for k, x in p.items()}
        self.t = 0

    def step(self, p, g, rate: float) -> None:
        self.t += 1
        for k, x in g.items():
            at, x = x if isinstance(x, tuple) else (slice(None), x)
            x = np.clip(x, -1, 1)
            m, v = self.m[k], self.v[k]
            m[at] += 0.1 * (x - m[at])
            v[at] += 0.001 * (x * x - v[at])
            p[k][at] -= rate * (m[at] / (1 - 0.9 ** self.t)) / (np.sqrt(v[at] / (1 - 0.999 ** self.t)) + 1e-7)


def train(texts: list[str], labels: list[int], seed: int = 7, windows: tuple[int, int] = TRAIN_WINDOWS) -> Model | None:
    """Fit on whole texts with document labels; None without both labels.

    In the first epochs a window carries its document's label, and each epoch
    draws at most ``windows`` of a toxic and of a clean document anew; then each
    document trains its highest window over all of them (and clean ones three
    random ones beside).  Scoring takes every window.
    """
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    r = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    distinct = [{bare(w) for w in set(t)} for t in docs]
    df = Counter(w for t in distinct for w in t)
    hits = Counter(w for t, label in zip(distinct, labels) if label for w in t)
    known = sorted(w for w, n in df.items() if n >= MIN_DOCS)
    model = Model({w: i + 1 for i, w in enumerate(known)}, seed)
    # the first component of a word vector starts at its smoothed log-odds
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    for w, i in model.vocabulary.items():
        odds = np.log((hits[w] + 0.5) / (pos + 1)) - np.log((df[w] - hits[w] + 0.5) / (neg + 1))
        model.p["word"][i, 0] = np.clip(odds, -4, 4) / 2
    adam = Adam(model.p)
    spans = [windows_of(len(t)) for t in docs]
    heavier = min(8.0, neg / pos)
    per_epoch = max(1, round(sum(min(len(s), windows[not label]) for s, label in zip(spans, labels)) / BATCH))
    epochs = max(EPOCHS, min(80, MIN_STEPS // per_epoch))
    warm = round(WARM_SHARE * epochs)
    for epoch in range(epochs):
        chosen: list[tuple[int, int]] = []
        if epoch < warm:
            for i, s in enumerate(spans):
                pick = r.permutation(len(s))[:windows[not labels[i]]]
                chosen += [(i, int(k)) for k in pick]
        else:
            if (epoch - warm) % max(2, epochs // 5) == 0:
                logits, owner = model.window_logits(docs)
            ends = np.searchsorted(owner, np.arange(len(docs) + 1))
            for i in range(len(docs)):
                chosen.append((i, int(np.argmax(logits[ends[i]:ends[i + 1]]))))
                if not labels[i]:
                    chosen += [(i, int(k)) for k in r.integers(len(spans[i]), size=3)]
        order = r.permutation(len(chosen))
        for a in range(0, len(order), BATCH):
            part = [chosen[k] for k in order[a:a + BATCH]]
            rows = [docs[i][spans[i][k][0]:spans[i][k][1]] for i, k in part]
            place: dict[str, int] = {}
            index = padded([np.array([place.setdefault(w, len(place)) for w in row], np.int64) for row in rows])
            if not place:
                continue
            target = y[[i for i, _ in part]]
            weights = np.where(target > 0, heavier if epoch < warm else 1.0, 1.0)
            _, g = model.gradients(list(place), index, target, weights)
            adam.step(model.p, g, RATE * (1.0 if epoch < 0.6 * epochs else 0.3))
    # scale and offset of the documents' highest logits, by Newton steps with a weak prior
    logits, owner = model.window_logits(docs)
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, logits)
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * best + b)
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * best).sum() + 0.1 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * best * best).sum() + 0.1, (w * best).sum()], [(w * best).sum(), w.sum()]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - da, b - db
    model.scale = (max(float(a), 0.05), float(b))
    return model


def in_training_fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS,
        windows: tuple[int, int] = TRAIN_WINDOWS) -> Model | None:
    """Train on the labelled rows of the training fold, ``max_docs`` at most, with texts of at most ``max_chars``.

    Labels other than 0 and 1 and null ids are left out; an id with both
    labels counts as 1; of rows with one id the smallest text trains.
    """
    marked = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_training_fold(id_col))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_docs))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.join(marked, F.col(id_col) == F.col("_id")).where(F.length(text) <= max_chars)
            .groupBy("_id").agg(F.min(text).alias("t"), F.max("_y").alias("y"))).collect()
    rows = sorted(rows, key=lambda r: r["_id"])
    return train([r["t"] for r in rows], [int(r["y"]) for r in rows], windows=windows)


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; a column of the score's name is replaced.

    A null or empty text, or one without words, is scored as one empty window;
    without a model (no labels of both kinds) every score is 0.  Whole texts
    count, repeated rows score alike, an empty table stays empty.
    """
    docs = docs.drop(score_col)
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(model)
        for batch in slices(batches, 64):
            scores = model.scores([t or "" for t in batch.column(at).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))
