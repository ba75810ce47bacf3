"""Toxicity scores from a subsequence string kernel SVM with Nystrom landmarks.

The kernel compares words by the three-letter subsequences they share, gaps included: each occurrence weighs
DECAY to the power of its extent, steps of up to three letters count, and values are normalised. A word with letters
put in or left out stays close to the original. Landmarks are words that stand out in toxic training texts; a
document is the sum of its words' kernel values to each landmark, turned by the inverse root of the landmarks' own
kernel matrix (Nystrom), and a linear SVM with a logistic link scores it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Members, mix, slices, written

DECAY, STEP, WIDTH = 0.7, 3, 24
#: Kernel values under this count as zero: what unrelated words share by chance.
FLOOR = 0.45


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between spaces; runs of single letters are one word, long words overlapping pieces."""
    out: list[str] = []
    held = ""
    for w in text.lower().split() if text else ():
        if len(w) == 1:
            held += w
            continue
        if held:
            out.append(held)
            held = ""
        out.append(w)
    if held:
        out.append(held)
    if any(len(w) > WIDTH for w in out):
        out = [w[i : i + WIDTH] for w in out for i in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2)]
    return out


def letters(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)


def subsequences(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, weight) of every three-letter subsequence with steps of 1 to STEP letters."""
    row, key, weight = [], [], []
    longest = int((m > 0).sum(1).max(initial=0))
    m = m[:, :longest]
    for a in range(1, STEP + 1):
        for b in range(1, STEP + 1):
            if longest <= a + b:
                continue
            last = m[:, a + b :]
            r, c = np.nonzero(last)
            x = (m[r, c] * np.uint64(0x1F123BB5)) ^ (m[r, c + a] << np.uint64(24)) ^ (last[r, c] << np.uint64(43))
            row.append(r)
            key.append(mix(x))
            weight.append(np.full(len(r), DECAY ** (a + b + 1)))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(row), np.concatenate(key), np.concatenate(weight)


def _merged(row: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per word and subsequence."""
    order = np.lexsort((key, row))
    row, key, weight = row[order], key[order], weight[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.add.reduceat(weight, at) if len(at) else weight


class Landmarks:
    """Kernel values of words to landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        row, key, weight = _merged(*subsequences(letters(words)))
        norm = np.sqrt(np.bincount(row, weight**2, len(words)))
        self.keys = Members(key)
        self.table = np.zeros((len(self.keys.values), len(words)))
        self.table[np.searchsorted(self.keys.values, key), row] = weight / norm[row]
        self.bound = self.table.max(1)

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, kernel values) of the words that reach FLOOR at some landmark; others are all zero."""
        row, key, weight = subsequences(letters(words))
        at = self.keys.find(key)
        hit = at >= 0
        # sums over occurrences bound the norm from below, so the ratio bounds the kernel from above
        norm = np.sqrt(np.bincount(row, weight**2, len(words)))
        top = np.bincount(row[hit], weight[hit] * self.bound[at[hit]], len(words))
        may = np.flatnonzero((norm > 0) & (top >= FLOOR * norm))
        if not len(may):
            return may, np.zeros((0, len(self.words)))
        place = np.full(len(words), -1, np.int64)
        place[may] = np.arange(len(may))
        on = place[row] >= 0
        r, k, w = _merged(place[row[on]], key[on], weight[on])
        norm = np.sqrt(np.bincount(r, w**2, len(may)))
        at = self.keys.find(k)
        r, w, at = r[at >= 0], w[at >= 0], at[at >= 0]
        out = np.zeros((len(may), len(self.words)))
        for i in range(0, len(may), 4096):
            part = (r >= i) & (r < i + 4096)
            dense = np.zeros((min(4096, len(may) - i), len(self.table)), np.float32)
            dense[r[part] - i, at[part]] = w[part]
            out[i : i + 4096] = dense @ self.table
        out /= norm[:, None]
        out[out < FLOOR] = 0
        keep = out.any(1)
        return may[keep], out[keep]


class Features:
    """Sums of kernel values over the words of whole texts; values of words met before are kept."""

    def __init__(self, landmarks: list[str], most: int = 300_000):
        self.marks, self.most = Landmarks(landmarks), most
        self.known: dict[str, np.ndarray | None] = {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = list(set(chain.from_iterable(docs)).difference(self.known))
        for at in range(0, len(new), 4_000):
            part = new[at : at + 4_000]
            self.known.update(dict.fromkeys(part))
            for i, v in zip(*self.marks.values(part)):
                self.known[part[i]] = v
        out = np.zeros((len(texts), len(self.marks.words) + 1))
        get = self.known.get
        for i, words in enumerate(docs):
            for v in filter(lambda v: v is not None, map(get, words)):
                out[i, :-1] += v
            out[i, -1] = len(words)
        return out


@dataclass
class Model:
    """landmarks empty: too little to learn from, every score is the share of toxic labels."""

    landmarks: list[str]
    turn: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    link: tuple[float, float]

    def inputs(self, sums: np.ndarray) -> np.ndarray:
        near, n = sums[:, :-1], sums[:, -1:]
        x = np.hstack([np.log1p(near) @ self.turn, np.log1p(near.sum(1, keepdims=True)), near.sum(1, keepdims=True) / np.sqrt(n + 1), near.max(1, keepdims=True, initial=0) / np.sqrt(n + 1), np.log1p(n)])
        return x

    def scores(self, sums: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(sums), self.link[1])
        x = (self.inputs(sums) - self.mean) / self.scale
        margin = np.hstack([x, np.ones((len(x), 1))]) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.link[0] * margin + self.link[1], -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Linear SVM in the primal by Newton steps over the support vectors; the last input is the bias."""
    w = np.zeros(x.shape[1])
    eye = np.full(x.shape[1], ridge)
    eye[-1] = 1e-8
    for _ in range(rounds):
        on = y * (x @ w) < 1
        new = np.linalg.solve(np.diag(eye) + (x[on] * cost[on, None]).T @ x[on], (x[on] * cost[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w


def logistic_link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, with his smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-12
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _feature_rows(landmarks: list[str]):
    def run(batches):
        of = Features(landmarks).of
        for batch in slices(batches, "text"):
            sums = of(batch.column(1).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["toxic", "sums"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, landmarks: int = 96, seen: str = "pmod(crc32(cast(doc_id AS string)), 5) <> 0") -> Model:
    """Fits on a bounded sample: `most_rows` labelled documents that satisfy `seen`, the first by a hash of the id.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; other values and nulls are left out; of repeated ids the
    greatest label counts).
    """
    label = labels.select("doc_id", "toxic").where(f"toxic IN (0, 1) AND {seen}").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    label = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(label), "doc_id").select(F.col("toxic").cast("long"), "text"), "labelled")
    n, up = sample.agg(F.count("*"), F.sum("toxic")).first()
    up = up or 0
    share = float(up / n) if n else 0.0
    none = Model([], *[np.zeros(0)] * 4, (0.0, share))
    if not up or up == n:
        return none
    word = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))).alias("word"))
    counts = word.where(f"length(word) BETWEEN 3 AND {WIDTH}").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("k")).where("a >= 2")
    # how far the share of toxic texts among those with the word stands above the sample's, in standard errors
    stand = (F.col("a") - F.col("k") * share) / F.sqrt(F.col("k") * share * (1 - share) + 0.5)
    best = [r["word"] for r in counts.orderBy(stand.desc(), "word").limit(landmarks).collect()]
    best = [w for w, v in zip(best, letters(best)) if len(subsequences(v[None])[0])] if best else []
    if not best:
        return none
    rows = sample.select("toxic", "text").mapInArrow(_feature_rows(best), "toxic long, sums array<double>").toPandas()
    sums, y = np.stack(rows["sums"]), np.where(rows["toxic"] > 0, 1.0, -1.0)
    order = np.lexsort((*sums.T, y))
    sums, y = sums[order], y[order]
    marks = Landmarks(best)
    kernel = np.zeros((len(best), len(best)))
    at, v = marks.values(best)
    kernel[at] = v
    vals, vecs = np.linalg.eigh((kernel + kernel.T) / 2)
    on = vals > 1e-3 * vals.max()
    model = Model(best, vecs[:, on] / np.sqrt(vals[on]), *[np.zeros(0)] * 3, (1.0, 0.0))
    x = model.inputs(sums)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    cost = np.full(len(y), 1 / len(y))
    fold = np.arange(len(y)) % 5
    margin = np.zeros(len(y))
    for k in range(5):  # the link is fitted on margins of texts that the weights have not seen
        margin[fold == k] = x[fold == k] @ squared_hinge(x[fold != k], y[fold != k], cost[fold != k], 1e-3)
    model.weight = squared_hinge(x, y, cost, 1e-3)
    model.link = logistic_link(margin, y)
    return model


def _score_rows(model: Model):
    def run(batches):
        features = Features(model.landmarks) if model.landmarks else None
        for batch in slices(batches, "text"):
            texts = batch.column(1)
            s = model.scores(features.of(texts.to_pylist())) if features else model.scores(np.zeros((batch.num_rows, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row; a null text counts as empty.

    docs: doc_id, text; other columns are ignored, whatever their names. Only the text is an input. Rows that repeat
    give rows that repeat; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(_score_rows(model), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep_rows(model: Model):
    def run(batches):
        features = Features(model.landmarks) if model.landmarks else None
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.names.index("text"))
            s = model.scores(features.of(texts.to_pylist())) if features else np.zeros(batch.num_rows)
            yield batch.filter(pa.array(s < 0.5))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs (all columns) without the rows whose score reaches 0.5."""
    return docs.mapInArrow(_keep_rows(train(docs, labels, **how)), docs.schema)
