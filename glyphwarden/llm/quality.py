"""Quality classifier (operator 9): naive Bayes support vectors.

Features are indicators of n-grams: of words (hashed), and of one to three word shapes in
a row, a shape being a word's character classes together with whether the word repeats the
one before it.  Each indicator is scaled by its log-count ratio between the labels, and a
linear model with hinge loss is fitted by dual coordinate descent on a bounded sample
(`per_class` rows of each label), with the losses of each label weighing the same.  A
logistic curve fitted on a fifth of the sample, held back from the descent, turns margins
into scores from 0 to 1.

Special cases: a null or empty text has the bias alone; with rows of one label only, or
none, every score is that label's share (0.5 without rows); repeated rows are scored one
by one, and one text of a repeated id is learned from; texts of any length are read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .shared import mix64, slices

BITS = 18
_WORDS, _SHAPES = 1 << BITS, 1 << BITS


def shape(word: str) -> str:
    """Character classes without repeats: U upper, l lower or other letter, 9 digit, else the character; at most 6."""
    out, last = [], ""
    for c in word:
        k = "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
            if len(out) == 6:
                break
        elif len(out) < 6 and k not in "Ul9" and (len(out) < 2 or out[-2] != k):
            out.append(k)  # a doubled sign is told from a single one
    return "".join(out)


def _code(word: str) -> int:
    """40 bits of the word's hash above 22 bits of its shape's."""
    h = xxhash.xxh3_64_intdigest(word.lower()) >> 24
    return (h << 22 | xxhash.xxh3_64_intdigest(shape(word)) >> 42) & 0x3FFFFFFFFFFFFFFF


def features(codes: np.ndarray) -> np.ndarray:
    """Ascending distinct feature numbers of a text from its words' codes."""
    if not codes.size:
        return np.zeros(0, np.int32)
    word, form = (codes >> 22).astype(np.uint64), (codes & 0x3FFFFF).astype(np.uint64)
    same = np.zeros(codes.size, np.uint64)
    same[1:] = word[1:] == word[:-1]
    one = mix64(form * np.uint64(2) + same + np.uint64(1))
    grams = [one]
    for n in (2, 3):
        if codes.size >= n:
            grams.append(mix64(grams[-1][:-1] * np.uint64(31) + one[n - 1 :] + np.uint64(n)))
    shapes = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32) + _WORDS
    return np.unique(np.concatenate([(mix64(word) >> np.uint64(64 - BITS)).astype(np.int32), shapes]))


class Texts:
    """Feature numbers of texts, with a bounded cache of word codes."""

    def __init__(self):
        self.cache = labelled.WordCache(_code)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        return features(np.array(self.cache.of(words), np.int64))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Hinge-loss weights by dual coordinate descent; rows are scaled indicators of length 1; the last weight is the bias."""
    w, alpha, rng = np.zeros(scale.size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    values = [scale[r] for r in rows]
    values = [v / (np.sqrt((v * v).sum()) or 1.0) for v in values]
    squares = np.array([(v * v).sum() + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / squares[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve of y (0, 1) on margins, by Newton's steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, d = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * m).sum() + 1e-2 * a, g.sum()])
        hess = np.array([[(d * m * m).sum() + 1e-2, (d * m).sum()], [(d * m).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, scale: np.ndarray, weights: np.ndarray, a: float, b: float):
        self.scale, self.bias, self.a, self.b = scale.astype(np.float32), float(weights[-1]), a, b
        self.product = (scale * weights[:-1]).astype(np.float32)

    def margin(self, f: np.ndarray) -> float:
        norm = float(np.sqrt((self.scale[f].astype(float) ** 2).sum())) or 1.0
        return float(self.product[f].sum(dtype=float)) / norm + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(f) + self.b, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray, share: dict[int, float]) -> Model | float:
    """A model of feature rows with labels 0 and 1; a constant where there is one label only."""
    if not len(rows) or y.min() == y.max():
        return float(y[0]) if len(rows) else 0.5
    back = np.arange(len(rows)) % 5 == 4
    if min((y[~back] == 1).sum(), (y[~back] == 0).sum(), (y[back] == 1).sum(), (y[back] == 0).sum()) == 0:
        back[:] = False
    n = _WORDS + _SHAPES
    count = {v: 1 + np.bincount(np.concatenate([r for r, k, h in zip(rows, y, back, strict=True) if k == v and not h] or [np.zeros(0, int)]), minlength=n) for v in (0, 1)}
    scale = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    fit = np.flatnonzero(~back)
    sign = np.where(y == 1, 1.0, -1.0)
    each = {v: (y[fit] == v).sum() for v in (0, 1)}
    cost = np.where(y == 1, len(fit) / (2 * each[1]), len(fit) / (2 * each[0]))
    w = descend([rows[i] for i in fit], sign[fit], scale, cost[fit])
    model = Model(scale, w, 1.0, 0.0)
    check = np.flatnonzero(back) if back.any() else fit
    model.a, model.b = logistic(np.array([model.margin(rows[i]) for i in check]), y[check].astype(float), np.array([share[int(v)] for v in y[check]]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = 4000) -> Model | float:
    texts, sizes = labelled.sample(docs, labels, label, usable, per_class)

    def run(batches):
        of = Texts()
        for b in batches:
            for s in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([of(t).astype("<i4").tobytes() for t in s.column(2).to_pylist()], pa.binary())], names=["y", "h", "f"])

    got = texts.mapInArrow(run, "y int, h long, f binary").orderBy("h", "y", "f").collect()
    rows = [np.frombuffer(r["f"], "<i4") for r in got]
    y = np.array([r["y"] for r in got], int)
    n = {v: int((y == v).sum()) for v in (0, 1)}
    # a label's rows stand for all rows of that label in the curve
    share = {v: sizes.get(v, 0) / max(n[v], 1) / max(sum(sizes.values()), 1) * max(len(rows), 1) for v in (0, 1)}
    return train(rows, y, share)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m, of = held.value, Texts()
        for b in batches:
            for s in slices(b, "text"):
                texts = s.column(1).to_pylist()
                got = [m if isinstance(m, float) else m.score(of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, score double")
