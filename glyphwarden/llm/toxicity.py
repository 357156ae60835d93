"""Toxicity (operator 2): nearest labelled examples by exact TF-IDF cosine.

Terms are the words of whole texts (digits, letters and all beyond ASCII; A-Z as a-z), by
their 64-bit hashes.  The examples are a bounded sample of labelled rows (`per_class` of each
label; those with the same set of terms and label count once).  Every term of every example is in the
vocabulary; none is chosen or left out.  A text's vector has (1 + log times) * idf * told for
each of its terms in the vocabulary: idf by the rows of all documents that have the term, and told =
`floor` + the size of the correlation of the term with the label among the examples, so
that words which say nothing about the label turn the direction of a vector less, though all do.

The examples stand in an inverted index with block maxima (blockmax.py); a document's `k`
nearest are exact, with cosines rounded to 9 decimals and equal ones in index order.  Their
votes, weighted by cosine and by the share of their label, are calibrated by isotonic
regression on the examples' own votes, each without itself.  Evidence is the nearest
examples' ids (hashes), labels and cosines.

Special cases: a text without known terms (null and empty ones too) gets the share of label
1; with no labelled rows every score is 0; repeated rows are scored one by one, and one text
of a repeated id is learned from; null ids and labels are not learned from; texts of any length
are read whole; columns of the names given by `out` are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from . import labelled
from .blockmax import Index, k_best
from .shared import crc_remainder, slices, stored, tidy, utf8_column
from .wordhash import SIGNS, term_counts

DIGITS = 9


def correlation(with_term: np.ndarray, toxic_with_term: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Pearson's correlation of two indicators, from 0 to 1 without its sign; 0 where one of them is constant."""
    d, b = with_term.astype(float), toxic_with_term.astype(float)
    spread = d * (n - d) * n_toxic * (n - n_toxic)
    return np.abs(n * b - d * n_toxic) / np.sqrt(np.where(spread > 0, spread, np.inf))


class Model:
    """The vocabulary with its weights, the examples' index and the calibration.

    `begins`, `place`, `times` are the examples' terms as places in `vocabulary`; df has the rows of all documents with each term.
    """

    def __init__(self, vocabulary: np.ndarray, df: np.ndarray, n_docs: int, begins: np.ndarray, place: np.ndarray, times: np.ndarray, y: np.ndarray, names: np.ndarray, share: dict[int, float], k: int, floor: float):
        self.vocabulary, self.k, self.y, self.names = vocabulary, k, y.astype(float), names
        n = y.size
        who = np.repeat(np.arange(n), np.diff(begins))
        told = floor + correlation(np.bincount(place, minlength=vocabulary.size), np.bincount(place, weights=self.y[who], minlength=vocabulary.size), n, int(y.sum()))
        self.value = (np.log((1 + n_docs) / (1 + df)) + 1) * told
        self.weight = np.where(y == 1, share.get(1, 0.0), share.get(0, 0.0))
        self.base = float((self.weight * self.y).sum() / self.weight.sum()) if n else 0.0
        impact = self.vectors(begins, place, times)
        order = np.argsort(place, kind="stable")
        self.index = Index(n, np.concatenate([[0], np.cumsum(np.bincount(place, minlength=vocabulary.size))]), who[order].astype(np.int32), impact[order])
        query, other, sim = self.nearest(begins, place, impact, k + 1)
        away = query != other  # each without itself
        query, other, sim = query[away], other[away], sim[away]
        first = np.searchsorted(query, np.arange(n))
        keep = np.arange(query.size) - first[query] < k
        raw, seen = self.votes(query[keep], other[keep], sim[keep], n)
        self.steps, self.values = isotonic(raw[seen], self.y[seen], self.weight[seen])

    def known(self, terms: np.ndarray, row: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, places, times) of those of the terms of n rows that the vocabulary has."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), max(self.vocabulary.size - 1, 0))
        here = self.vocabulary[at] == terms if self.vocabulary.size else np.zeros(terms.size, bool)
        return np.searchsorted(row[here], np.arange(n + 1)), at[here], times[here]

    def vectors(self, begins: np.ndarray, place: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The values of the vectors, each of length 1."""
        v = (1 + np.log(times)) * self.value[place]
        size = np.diff(begins)
        squares = np.concatenate([[0.0], np.cumsum(v * v)])
        return v / np.sqrt(np.maximum(np.repeat(squares[begins[1:]] - squares[begins[:-1]], size), 1e-300))

    def nearest(self, begins: np.ndarray, place: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of the k nearest examples of each query, nearest first."""
        return k_best(*self.index.best(begins, place, values, k, DIGITS), k, DIGITS)

    def votes(self, query: np.ndarray, who: np.ndarray, sim: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(vote, whether there are neighbours) of n queries; half a neighbour's weight of the base share steadies few votes."""
        w = sim * self.weight[who]
        total, ones = np.bincount(query, weights=w, minlength=n), np.bincount(query, weights=w * self.y[who], minlength=n)
        calm = 0.5 * self.weight.mean()
        return (ones + calm * self.base) / (total + calm), np.bincount(query, minlength=n) > 0

    def score(self, terms: np.ndarray, row: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, list[str]]:
        """(score, evidence) of n rows from their terms, rows ascending."""
        begins, place, times = self.known(terms, row, times, n)
        query, who, sim = self.nearest(begins, place, self.vectors(begins, place, times), self.k)
        raw, seen = self.votes(query, who, sim, n)
        out = np.where(seen, np.clip(np.interp(raw, self.steps, self.values) if self.steps.size else raw, 0.0, 1.0), self.base)
        first = np.searchsorted(query, np.arange(n + 1))
        three = [range(a, min(a + 3, b)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return out, [" ".join(f"{self.names[who[i]]}:{int(self.y[who[i]])}:{sim[i]:.3f}" for i in r) for r in three]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (points, values) of the weighted non-decreasing fit, each pool moved by a pseudo-count to the middle."""
    blocks: list[list[float]] = []  # [sum of w*y, sum of w, first x, last x]
    unit = float(w.mean()) if w.size else 1.0
    for i in np.lexsort((y, x)):
        if blocks and blocks[-1][3] == x[i]:
            blocks[-1] = [blocks[-1][0] + w[i] * y[i], blocks[-1][1] + w[i], blocks[-1][2], x[i]]
        else:
            blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    points, values = [], []
    for s, total, lo, hi in blocks:
        v = (s + 0.25 * unit) / (total + 0.5 * unit)
        points += [lo, hi]
        values += [v, v]
    return np.array(points), np.maximum.accumulate(np.array(values)) if values else np.array(values)


def example_terms(texts: DataFrame) -> DataFrame:
    """texts(y, h, text) -> (y, h, mark of the set of terms, terms, times)."""

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                t, row, times, _ = term_counts(*utf8_column(s.column(2)), SIGNS)
                cuts = np.searchsorted(row, np.arange(s.num_rows + 1))
                sets = [t[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                each = [times[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary()), pa.array(each, pa.binary())], names=["y", "h", "mark", "terms", "times"])

    return texts.mapInArrow(run, "y int, h long, mark binary, terms binary, times binary")


def rows_with(docs: DataFrame, vocabulary: np.ndarray, pieces: int = 64) -> tuple[np.ndarray, int]:
    """How many rows of docs(text) have each term of a bounded vocabulary, and how many rows there are; summed by task, then by piece of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    cuts = np.linspace(0, vocabulary.size, pieces + 1).astype(int)

    def count(batches):
        names = held.value
        n, total = 0, np.zeros(names.size, np.int64)
        for b in batches:
            for s in slices(b, "text"):
                t = term_counts(*utf8_column(s.column(0)), SIGNS)[0]
                at = np.minimum(np.searchsorted(names, t), max(names.size - 1, 0))
                if names.size:
                    total += np.bincount(at[names[at] == t], minlength=names.size)
                n += s.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([total[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([n] * pieces, pa.int64())], names=["piece", "counts", "n"])
        tidy()

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"piece": t.column("piece").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    rows = docs.mapInArrow(count, "piece int, counts binary, n long").groupBy("piece").applyInArrow(add, "piece int, counts binary, n long").collect()
    rows.sort(key=lambda r: r["piece"])
    held.unpersist()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows] or [np.zeros(vocabulary.size, np.int64)]), rows[0]["n"] if rows else 0


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = 3000, k: int = 15, floor: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model of a bounded sample of labelled rows and the statistics of all documents; None without labelled rows."""
    texts, sizes = labelled.sample(docs, labels, label, usable, per_class, id_col, text_col)
    if not sizes:
        return None
    found = stored(example_terms(texts), "examples")
    # a text copied often counts once: the one of least hash
    first = found.groupBy("mark", "y").agg(F.min("h").alias("h"))
    kept = found.join(F.broadcast(first), ["mark", "y", "h"], "left_semi").collect()  # at most 2 * per_class rows
    if not kept:
        return None
    kept.sort(key=lambda r: (r["y"], r["h"], r["mark"]))
    terms = [np.frombuffer(r["terms"], np.uint64) for r in kept]
    times = np.concatenate([np.frombuffer(r["times"], np.int32) for r in kept])
    vocabulary, place = np.unique(np.concatenate(terms), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum([t.size for t in terms])])
    y = np.array([r["y"] for r in kept])
    df, n_docs = rows_with(docs.select(F.col(text_col).alias("text")), vocabulary)
    share = {v: sizes.get(v, 0) / max(int((y == v).sum()), 1) for v in (0, 1)}
    return Model(vocabulary, df, n_docs, begins, place, times, y, np.array([r["h"] for r in kept]), share, k, floor)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """The rows with a score from 0 to 1 and the evidence for it; columns of these names are replaced."""
    kept = docs.drop(*out)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def run(batches):
        m = held.value
        for b in batches:
            for s in slices(b, text_col, 1_000_000):
                t, row, times, _ = term_counts(*utf8_column(s.column(at)), SIGNS)
                got, why = m.score(t, row, times, s.num_rows) if m else (np.zeros(s.num_rows), [""] * s.num_rows)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(got, pa.float64()), pa.array(why, pa.string())], names=[*s.schema.names, *out])
        tidy()

    schema = StructType([*kept.schema.fields]).add(out[0], DoubleType()).add(out[1], StringType())
    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", m: int = 3, r: int = 1) -> Column:
    return crc_remainder(F.col(id_col), m) == r


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns and rows without those whose score reaches the threshold; rows without a text stay unless their label's share does."""
    model = fit(docs, labels, "toxic", crc_remainder(F.col("id"), 3) != 1, id_col=id_col, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for b in batches:
            for s in slices(b, text_col, 1_000_000):
                if m:
                    t, row, times, _ = term_counts(*utf8_column(s.column(at)), SIGNS)
                    s = s.filter(pa.array(m.score(t, row, times, s.num_rows)[0] < threshold))
                yield s
        tidy()

    return docs.mapInArrow(run, docs.schema)
