"""Toxicity: a linear SVM over Nyström features of a gapped-subsequence string kernel.

The kernel of two strings counts their common subsequences of ``LENGTH``
characters, each weighed by DECAY to the power of the characters it spans in
both, so inserted and missing characters cost a little instead of everything.
Landmarks are character runs picked from labelled sentences (texts).  A text's
value at a landmark is the largest normalised kernel of one of its words; the
Nyström map multiplies these by the inverse root of the landmarks' own kernel
matrix; a hinge-loss SVM and Platt's sigmoid follow.

A word is a run between white space with everything but letters taken out
(so i.d.i.o.t is one word), lower-cased; runs of single letters are one word.
Words over WIDTH letters are seen through overlapping windows of WIDTH.  The
kernel counts as 0 where the word has too few of a landmark's letter pairs
within a gap of two; a worker computes each distinct word once.

Fit: at most MOST_TOXIC and MOST_CLEAN labelled rows (by hash of doc_id) with
texts up to MOST_CHARS, never of the held-out fold.  Scoring reads only texts.
Null, empty or wordless text: all values 0, scored like any other.  Labels
that are null or of one class only: every score is that class's share (0.5
without labels).  Repeated rows score alike.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import forget, id_and_text, kept, slices, trim

LENGTH, DECAY, WIDTH = 3, 0.6, 24
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1000, 2000, 40_000
LANDMARKS = 48
MEMO = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
FOLDS = 5
SINGLES = re.compile(r"(?<!\S)(?:\w[\W_]*\s+){2,}\w(?!\w)")


def words_in(text: str) -> set[str]:
    """The distinct words of a text."""
    text = text.lower()
    parts = set(text.split())
    out = set()
    for part in parts:
        word = part if part.isalpha() else "".join(LETTERS.findall(part))
        if len(word) >= LENGTH:
            out.add(word)
    if " " in text:
        for m in SINGLES.finditer(text):
            out.add("".join(LETTERS.findall(m.group())))
    return out


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[k : k + WIDTH] for k in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word, 0 after its end."""
    data = np.frombuffer("".join(w.ljust(WIDTH, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return data.reshape(len(words), WIDTH)


def kernel(a: np.ndarray, b: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gapped-subsequence kernel of a[k] and b[k] for every row k."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)
    before = np.ones((n, wa + 1, wb + 1))
    total = np.zeros(n)
    for step in range(1, length + 1):
        if step == length:
            return (decay**2 * before[:, :-1, :-1] * same).sum((1, 2))
        now = np.zeros((n, wa + 1, wb + 1))
        inner = np.zeros((n, wb + 1))
        for i in range(1, wa + 1):
            hit = decay**2 * before[:, i - 1, :-1] * same[:, i - 1]
            inner[:] = 0
            for j in range(1, wb + 1):
                inner[:, j] = decay * inner[:, j - 1] + hit[:, j - 1]
            now[:, i] = decay * now[:, i - 1] + inner
        before = now
    return total


class Landmarks:
    def __init__(self, names: list[str]):
        self.names = names
        self.width = max(map(len, names))
        self.codes = codes(names)[:, : self.width]
        self.norm = np.sqrt(kernel(self.codes, self.codes))
        pairs = sorted({(x[k], x[k + 1]) for x in names for k in range(len(x) - 1)})
        self.alphabet = sorted({c for p in pairs for c in p})
        code = {c: k + 1 for k, c in enumerate(self.alphabet)}
        size = len(self.alphabet) + 1
        self.table = np.full(size * size, len(pairs), np.int32)
        for k, (x, y) in enumerate(pairs):
            self.table[code[x] * size + code[y]] = k
        self.size = size
        where = {p: k for k, p in enumerate(pairs)}
        self.holds = np.zeros((len(pairs) + 1, len(names)), np.float32)
        for j, x in enumerate(names):
            for k in range(len(x) - 1):
                self.holds[where[x[k], x[k + 1]], j] = 1
        self.least = np.maximum(1, np.ceil(0.75 * self.holds.sum(0)))

    def values(self, words: list[str]) -> list[list[tuple[int, float]]]:
        """For each word, the landmarks it is near to with the normalised kernel."""
        out: list[list[tuple[int, float]]] = [[] for _ in words]
        if not words:
            return out
        every = codes(words)
        places = np.searchsorted(np.array([ord(c) for c in self.alphabet], np.uint32), every)
        places[places == len(self.alphabet)] = 0
        small = np.where(np.array([ord(c) for c in self.alphabet], np.uint32)[places] == every, places + 1, 0)
        has = np.zeros((len(words), self.holds.shape[0]), np.float32)
        rows = np.arange(len(words))[:, None]
        for gap in (1, 2, 3):
            has[rows, self.table[small[:, :-gap] * self.size + small[:, gap:]]] = 1
        has[:, -1] = 0
        which, mark = np.nonzero(has @ self.holds >= self.least)
        for low in range(0, len(which), 4096):
            w, m = which[low : low + 4096], mark[low : low + 4096]
            distinct, inverse = np.unique(w, return_inverse=True)
            norm = np.sqrt(kernel(every[distinct], every[distinct]))[inverse] * self.norm[m]
            for k, j, v in zip(w.tolist(), m.tolist(), (kernel(every[w], self.codes[m]) / np.maximum(norm, 1e-12)).tolist()):
                out[k].append((j, v))
        return out

    def features(self, texts: list[str], memo: dict) -> np.ndarray:
        found = np.zeros((len(texts), len(self.names)))
        bags = [words_in(t) for t in texts]
        new = list(set().union(*bags) - memo.keys()) if bags else []
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set().union(*bags))
        for low in range(0, len(new), 8192):
            part = new[low : low + 8192]
            seen = [(w, x) for w in part for x in windows(w)]
            for w in part:
                memo[w] = None
            for (w, _), near in zip(seen, self.values([x for _, x in seen])):
                if near:
                    memo[w] = near if memo[w] is None else memo[w] + near
        for row, bag in zip(found, bags):
            for word in bag:
                if (near := memo[word]) is not None:
                    for j, v in near:
                        if v > row[j]:
                            row[j] = v
        return found


def pick_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Runs of 4 to 6 letters that tell toxic from clean texts: each pick is the one that covers most toxic texts not yet covered twice."""

    def runs(text: str) -> set[str]:
        return {w[k : k + n] for w in words_in(text) for n in (4, 5, 6) for k in range(len(w) - n + 1)}

    bad = [runs(t) for t, y in zip(texts, toxic) if y]
    support = Counter(r for own in bad for r in own)
    floor = max(2, len(bad) // 100)
    kept = {r for r, c in support.items() if c >= floor}
    clean = Counter()
    for t, y in zip(texts, toxic):
        if not y:
            clean.update(runs(t) & kept)
    n_clean = max(1, len(texts) - len(bad))
    good = {r: support[r] / len(bad) - 4 * clean[r] / n_clean for r in kept}
    good = {r: v for r, v in good.items() if v > 0}
    cover = [own & good.keys() for own in bad]
    times = [0] * len(bad)
    picked: list[str] = []
    while good and len(picked) < LANDMARKS:
        gain = Counter(r for own, k in zip(cover, times) if k < 2 for r in own if r in good)
        if not gain:
            break
        best = max(gain, key=lambda r: (gain[r] * good[r] / support[r] * len(bad), len(r), r))
        picked.append(best)
        for k, own in enumerate(cover):
            times[k] += best in own
        good = {r: v for r, v in good.items() if r not in best and best not in r}
    return picked


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """Hinge loss with classes weighed alike, by averaged subgradient steps in a fixed order."""
    signs = np.where(y > 0, 1.0, -1.0)
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    full = np.hstack([x, np.ones((len(x), 1))])
    w, mean = np.zeros(full.shape[1]), np.zeros(full.shape[1])
    for t in range(1, rounds * 20 + 1):
        open_ones = signs * (full @ w) < 1
        step = strength * w - ((weigh * signs * open_ones)[:, None] * full).sum(0)
        w = w - step / (strength * (t + 200))
        if t > rounds * 10:
            mean += w / (rounds * 10)
    return mean[:-1], float(mean[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Sigmoid over margins, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(d * margin).sum() + 1e-6 * a, d.sum()]))
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.labelled = len(toxic) > 0
        self.share = float(np.mean(toxic)) if self.labelled else 0.5
        self.landmarks = None
        if len(toxic) and 0 < self.share < 1 and (names := pick_landmarks(texts, toxic)):
            self.landmarks = Landmarks(names)
            marks = self.landmarks
            size = len(names)
            gram = kernel(np.repeat(marks.codes, size, 0), np.tile(marks.codes, (size, 1))).reshape(size, size) / np.outer(marks.norm, marks.norm)
            values, vectors = np.linalg.eigh(gram)
            self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
            x = marks.features(texts, {}) @ self.map
            fold = np.arange(len(texts)) % 4
            margin = np.zeros(len(texts))
            for k in range(4):  # margins of texts that the weights have not seen
                w, b = svm(x[fold != k], toxic[fold != k])
                margin[fold == k] = x[fold == k] @ w + b
            self.weights, self.bias = svm(x, toxic)
            self.slope, self.shift = platt(margin, toxic)

    def state(self) -> dict:
        """Plain values that of() makes the same model from."""
        return vars(self) | {"landmarks": self.landmarks and vars(self.landmarks)}

    @classmethod
    def of(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(state)
        if model.landmarks:
            model.landmarks = Landmarks.__new__(Landmarks)
            vars(model.landmarks).update(state["landmarks"])
        return model

    def scores(self, texts: list[str], memo: dict) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.share)
        margin = self.landmarks.features(texts, memo) @ self.map @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def fold_of(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(fold_of() != 0)
    order = F.xxhash64("doc_id")
    texts = id_and_text(docs).where(F.length("text") <= MOST_CHARS)
    picked = []
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        # Twice the bound of ids, so that long or missing texts leave enough.
        ids = known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(2 * most)
        picked.append(texts.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text").limit(most).select("doc_id", "text", F.col("toxic").cast("long").alias("toxic")))

    def trained(rows: list[dict]) -> bytes:
        rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["text"]))
        return pickle.dumps(Model([r["text"] for r in rows], np.array([int(r["toxic"] > 0) for r in rows])).state())

    def train(batches):
        forget()
        state = trained([r for batch in batches for r in batch.to_pylist()])
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

    # One task of an executor fits: the rows picked are bounded, but their runs of letters would stay in the driver's memory.
    found = picked[0].unionByName(picked[1]).coalesce(1).mapInArrow(train, "state binary").first()
    return Model.of(pickle.loads(found["state"] if found else trained([])))


def shipped(docs: DataFrame, model: Model):
    """A function for executors that gives (model, memo), made once in each worker."""
    packed = cloudpickle.dumps(model)
    spread, tag = docs.sparkSession.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()

    def fetch():
        return kept(("toxic", tag), lambda: (pickle.loads(spread.value), {}))

    return fetch


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    fetch = shipped(docs, model)

    def run(batches):
        model, memo = fetch()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), memo), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores under ``least``; all of them if no row was labelled."""
    if not model.labelled:
        return docs
    fetch = shipped(docs, model)

    def run(batches):
        model, memo = fetch()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(model.scores(texts, memo) < least))

    return docs.mapInArrow(run, docs.schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, fit(docs, labels)).select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
