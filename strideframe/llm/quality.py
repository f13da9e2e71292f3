"""Text quality by ordinal regression: one hashed-text score, ordered thresholds between grades.

A cumulative-link model says P(grade <= k) = sigmoid(threshold_k - score(text)). All grades share the
weights of the score; only the thresholds, kept in order, tell them apart. The model therefore gives an
expected grade and, for any grade, the probability of reaching it, which is what a selection cuts on.

The score is linear in hashed features of the whole text: shares of byte-shape trigrams (letter case,
digits, marks, blanks), the share of words that repeat the word before them, and presence of words.

Defined cases: null and empty texts have no features, so their score is 0 and the thresholds decide; ties
and repeated rows are scored one by one; with no labelled row the model accepts everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

SHAPES, WORDS = 1 << 12, 1 << 15
REPEATS = SHAPES
FEATURES = SHAPES + 1 + WORDS
PRESENCE = 0.05


def _classes() -> np.ndarray:
    """A small class per byte: one per mark, one each for lower, upper, digit and high bytes, blank, line end."""
    kinds = np.arange(256, dtype=np.int64)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 97, 65, 48, 97
    return kinds


CLASSES = _classes()


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) triples of every text of a slice."""
    shape = CLASSES[body]
    row = tb.rows_of(offsets)
    inside = np.flatnonzero(row[2:] == row[:-2]) if len(body) > 2 else np.zeros(0, np.int64)
    triple = (shape[inside] << 16) | (shape[inside + 1] << 8) | shape[inside + 2]
    code = (tb.mix(triple.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    keys, counts = np.unique(row[inside] * SHAPES + code, return_counts=True)
    per_row = np.maximum(np.diff(offsets) - 2, 1)
    parts = [(keys // SHAPES, keys % SHAPES, counts / per_row[keys // SHAPES])]

    starts, ends, bounds = tb.words(body, offsets, tb.SOLID)
    hashes, of = tb.span_hashes(body, starts, ends), tb.rows_of(bounds)
    same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of[1:][same], minlength=len(offsets) - 1) / np.maximum(np.diff(bounds), 1)
    seen = np.flatnonzero(again)
    parts.append((seen, np.full(len(seen), REPEATS), again[seen]))

    keys = np.unique(of * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64))
    parts.append((keys // WORDS, SHAPES + 1 + keys % WORDS, np.full(len(keys), PRESENCE)))
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; `tail(score, k)` is the probability of grade k or better."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([-50.0]))

    def tail(self, score: Column, grade: int) -> Column:
        return 1 / (1 + F.exp(F.lit(float(self.thresholds[grade - 1])) - score))

    def expected(self, score: Column) -> Column:
        return sum((self.tail(score, k + 1) for k in range(len(self.thresholds))), F.lit(0.0))

    def score(self, text: Column) -> Column:
        weights = self.weights

        @F.arrow_udf("double")
        def linear(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                batch = pa.RecordBatch.from_arrays([texts], ["text"])
                out = [np.zeros(0)]
                for _, body, offsets in tb.slices(batch, "text"):
                    row, column, value = features(body, offsets)
                    out.append(np.bincount(row, value * weights[column], minlength=len(offsets) - 1))
                yield pa.array(np.concatenate(out))

        return linear(text)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def feature_rows(sample: DataFrame, columns: list[str], extract) -> tuple[np.ndarray, ...]:
    """Features of a bounded sample, made in tasks: (row, feature, value, *columns by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, body, offsets in tb.slices(batch, "text"):
                row, feature, value = extract(body, offsets)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(rows) + 1))
                packed = [
                    (feature[part].astype("<i4").tobytes(), value[part].astype("<f4").tobytes())
                    for part in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()),
                     *[rows.column(c).cast(pa.float64()) for c in columns]],
                    ["f", "v", *columns],
                )

    got = sample.select("text", *columns).mapInArrow(run, "f binary, v binary, " + ", ".join(f"{c} double" for c in columns))
    # sorted, so that the fit doesn't depend on the order in which tasks end
    table = sorted((tuple(r) for r in got.toLocalIterator()), key=lambda r: (bytes(r[0]), bytes(r[1]), r[2:]))
    counts = [len(r[0]) // 4 for r in table]
    join = lambda k, kind: np.frombuffer(b"".join(bytes(r[k]) for r in table), kind)
    return (
        np.repeat(np.arange(len(table)), counts), join(0, "<i4"), join(1, "<f4").astype(float),
        *[np.array([r[2 + k] for r in table]) for k in range(len(columns))],
    )


def fit(docs: DataFrame, grades: DataFrame, fit_rows: int = 3600, steps: int = 80, decay: float = 1e-4) -> OrdinalModel:
    """A model from grades(doc_id, grade), whole numbers from 0, and the texts of docs(doc_id, text).

    At most `fit_rows` labelled rows are used, as many of each grade as there are, chosen by a hash of
    doc_id. Of several grades of one document the best counts; rows with nulls are left out.
    """
    known = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    top = known.agg(F.max("grade")).first()[0]
    if not top:
        return OrdinalModel()
    chosen = None
    for k in range(top + 1):
        part = known.where(F.col("grade") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // (top + 1))
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most fit_rows pairs of numbers, whatever the input
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    row, feature, value, grade = feature_rows(sample, ["grade"], features)
    grade = grade.astype(int)
    n = len(grade)
    if n == 0 or len(set(grade)) < 2:
        return OrdinalModel()
    counts = np.bincount(grade, minlength=top + 1)
    weight = (1 / np.maximum(counts, 1) / (counts > 0).sum())[grade]
    start = np.zeros(FEATURES + top)
    start[FEATURES] = -1.0

    def cuts(free: np.ndarray) -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def gradient(x: np.ndarray) -> np.ndarray:
        w, free = x[:FEATURES], x[FEATURES:]
        score = np.bincount(row, value * w[feature], minlength=n)
        bounds = np.concatenate([[-np.inf], cuts(free), [np.inf]])
        above, below = sigmoid(bounds[grade + 1] - score), sigmoid(bounds[grade] - score)
        above[grade == top], below[grade == 0] = 1.0, 0.0
        mass = np.maximum(above - below, 1e-9)
        pull = weight * (1 - above - below)
        g = np.empty_like(x)
        g[:FEATURES] = np.bincount(feature, value * pull[row], minlength=FEATURES) + decay * w
        by_cut = np.zeros(top)
        np.add.at(by_cut, grade[grade < top], (-weight * above * (1 - above) / mass)[grade < top])
        np.add.at(by_cut, grade[grade > 0] - 1, (weight * below * (1 - below) / mass)[grade > 0])
        rest = np.cumsum(by_cut[::-1])[::-1]
        g[FEATURES] = rest[0]
        g[FEATURES + 1:] = rest[1:] * np.exp(free[1:])
        return g

    x = adam(gradient, start, steps, 0.1)
    return OrdinalModel(x[:FEATURES].astype(np.float32), cuts(x[FEATURES:]))


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: 0 poor, 1 usable but toxic, 2 usable."""
    usable = F.col("quality") > 0
    return labels.select(
        "doc_id", F.when(~usable, 0).when(usable & (F.col("toxic") > 0), 1).when(usable, 2).alias("grade"),
    )


def select(docs: DataFrame, model: OrdinalModel, grade: int = 1, least: float = 0.5) -> DataFrame:
    """The documents, as they are, that reach `grade` with probability `least` or more."""
    score = model.score(F.col("text"))
    return docs.where(model.tail(score, grade) >= least)
