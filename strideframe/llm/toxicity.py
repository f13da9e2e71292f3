"""Toxicity without hand labels for every text: many weak voters, one generative model, one linear classifier.

1. Voters. Fixed lexicons and patterns, and lexicons of words and word beginnings that labelled toxic
   texts (learning rows only) hold far more often than others. Each says toxic, clean or nothing.
2. Label model. The votes of all documents are counted by vote pattern in Spark. Expectation
   maximisation on those counts estimates how often each voter is right in either class; voters whose
   votes still agree within a class are correlated, and their evidence is divided among them.
3. Classifier. A logistic model on hashed words and word beginnings learns the posteriors of
   a bounded sample, and scores every whole text.

Null and empty texts have no features: the intercept is their score. Ties and repeated rows are scored
alike. Without labelled rows only the fixed voters vote; without documents nothing is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textbytes as tb
from .quality import adam, feature_rows, sigmoid

#: Insults by kind, as voters read them.
LEXICONS = {
    "worth": "worthless pathetic useless loser scum trash garbage",
    "mind": "idiot moron stupid dumb imbecile fool clown",
    "disgust": "disgusting vile filthy repulsive hate",
}
#: Patterns on the lower-cased text.
PATTERNS = {
    "address": r"\byou(?:'re| are)? (?:a |an |such |so |all )*(?:idiot|moron|loser|scum|trash|stupid|worthless|pathetic|disgusting|clown)",
    "pair": r"\b(?:idiot|moron|loser|scum|trash|stupid|worthless|pathetic|disgusting|clown)\W+(?:idiot|moron|loser|scum|trash|stupid|worthless|pathetic|disgusting|clown)\b",
}
HEADS = (4, 5)
MINED = 1 + len(HEADS)
FEATURES = 1 << 18
ALWAYS = FEATURES - 1


def keys_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, hash) of each row's distinct words (kind 0) and word beginnings (kinds 1 and on)."""
    starts, ends, bounds = tb.words(body, offsets, tb.ALNUM)
    of, whole = tb.rows_of(bounds), tb.span_hashes(body, starts, ends)
    order = np.lexsort((whole, of))
    first = np.ones(len(order), bool)
    first[1:] = (of[order][1:] != of[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    kept = order[first]
    starts, ends, of = starts[kept], ends[kept], of[kept]
    found = [(of, np.zeros(len(of), np.int8), whole[kept])]
    for kind, n in enumerate(HEADS, 1):
        long = np.flatnonzero(ends - starts >= n)
        heads = tb.mix(tb.span_hashes(body, starts[long], starts[long] + n) + np.uint64(kind))
        rows = of[long]
        order = np.lexsort((heads, rows))
        rows, heads = rows[order], heads[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (heads[1:] != heads[:-1])
        found.append((rows[first], np.full(int(first.sum()), kind, np.int8), heads[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, _, hashes = keys_of(body, offsets)
    columns = (hashes % np.uint64(FEATURES - 1)).astype(np.int64)
    every = np.arange(len(offsets) - 1)
    return np.concatenate([rows, every]), np.concatenate([columns, np.full(len(every), ALWAYS)]), np.ones(len(rows) + len(every))


def learning(doc_id: Column) -> Column:
    """Rows that may teach: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def mined_lexicons(docs: DataFrame, labels: DataFrame, rows: int, size: int = 150) -> list[np.ndarray]:
    """Per kind (words, beginnings of each length), hashes of the `size` that most favour toxic texts: a voter each.

    Taken from at most `rows` labelled learning rows of each class, chosen by a hash of doc_id.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(learning(F.col("doc_id")))
    pick = lambda c: known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = pick("toxic > 0").unionByName(pick("toxic <= 0"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * rows pairs of numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text"):
                at, kinds, hashes = keys_of(body, offsets)
                bad = np.asarray(part.column("toxic"))[at] > 0
                keys, where, place = np.unique(hashes, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(kinds[where]), pa.array(np.bincount(place, bad, len(keys)).astype(np.int64)),
                     pa.array(np.bincount(place, ~bad, len(keys)).astype(np.int64))], ["h", "kind", "bad", "good"],
                )

    totals = chosen.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    bad, good = (float(x or 0) + 1 for x in totals)
    odds = F.log(((F.col("bad") + 0.1) / bad) / ((F.col("good") + 0.1) / good))
    counts = (
        sample.mapInArrow(count, "h long, kind tinyint, bad long, good long").groupBy("kind", "h")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(f"bad >= {max(3.0, 0.004 * bad)} AND good * {bad} <= 0.02 * bad * {good}")
        .select("kind", "h", (odds * F.sqrt("bad")).alias("gain"))
    )
    best = None
    for kind in range(MINED):
        part = counts.where(F.col("kind") == kind).orderBy(F.desc("gain"), "h").limit(size)
        best = part if best is None else best.unionByName(part)
    found = [(r["kind"], r["h"]) for r in best.collect()]  # at most MINED * size numbers
    return [np.sort(np.array([h for k, h in found if k == kind], np.int64).view(np.uint64)) for kind in range(MINED)]


def word_hashes(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = tb.words(body, np.array([0, len(body)]), tb.ALNUM)
    return np.sort(tb.span_hashes(body, starts, ends))


def votes(body: np.ndarray, offsets: np.ndarray, texts: pa.Array, lexicons: list[np.ndarray]) -> np.ndarray:
    """One column per voter: 1 toxic, 0 nothing to say (short text, nothing found), -1 clean."""
    import pyarrow.compute as pc

    n = len(offsets) - 1
    rows, _, hashes = keys_of(body, offsets)
    out = np.zeros((n, len(lexicons) + len(PATTERNS)), np.int8)
    seen = np.bincount(rows, minlength=n) > 3
    for k, known in enumerate(lexicons):
        hit = np.bincount(rows[np.isin(hashes, known)], minlength=n) > 0
        out[:, k] = np.where(hit, 1, np.where(seen, -1, 0))
    for k, pattern in enumerate(PATTERNS.values(), len(lexicons)):
        hit = np.asarray(pc.match_substring_regex(texts.fill_null(""), pattern, ignore_case=True).to_numpy(zero_copy_only=False), bool)
        out[:, k] = hit  # a pattern that isn't there says nothing
    return out


@dataclass
class LabelModel:
    """P(vote | class) of every voter, the share of toxic texts, and how much of each voter's evidence counts."""

    chance: np.ndarray  # class, voter, vote + 1
    prior: float
    share: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        at = np.arange(table.shape[1])
        logs = np.log(self.chance[:, at, table + 1]) * self.share
        gap = logs[1].sum(axis=1) - logs[0].sum(axis=1) + np.log(self.prior / (1 - self.prior))
        return sigmoid(gap)


def label_model(table: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
    """EM over vote patterns (one row each) and their counts."""
    n, voters = table.shape
    weight = counts / counts.sum()
    share = np.ones(voters)
    belief = np.clip((table > 0).sum(axis=1) / 2.0, 0.01, 0.99)
    model = None
    for step in range(rounds):
        prior = float(np.clip((weight * belief).sum(), 1e-4, 0.5))
        chance = np.empty((2, voters, 3))
        for c, mass in enumerate((1 - belief, belief)):
            for v in (-1, 0, 1):
                chance[c, :, v + 1] = ((table == v) * (weight * mass)[:, None]).sum(axis=0) + 1e-4
        chance /= chance.sum(axis=2, keepdims=True)
        if step in (10, 20):  # agreement that the class does not explain
            linked = np.zeros((voters, voters))
            for c, mass in enumerate((1 - belief, belief)):
                w = weight * mass
                total = w.sum() + 1e-12
                centred = (table > 0) - ((table > 0) * w[:, None]).sum(axis=0) / total
                cov = (centred * w[:, None]).T @ centred / total
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                linked = np.maximum(linked, np.clip(cov / np.outer(spread, spread), 0, 1))
            np.fill_diagonal(linked, 0)
            share = 1 / (1 + np.where(linked > 0.3, linked, 0).sum(axis=1))
        model = LabelModel(chance, prior, share)
        belief = model.posterior(table)
    return model


@dataclass
class ToxicityModel:
    weights: np.ndarray
    lexicons: list[np.ndarray]
    labels: LabelModel | None

    def score(self, text: Column) -> Column:
        weights = self.weights

        @F.arrow_udf("double")
        def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                batch = pa.RecordBatch.from_arrays([texts], ["text"])
                out = [np.zeros(0)]
                for _, body, offsets in tb.slices(batch, "text"):
                    row, column, value = features(body, offsets)
                    out.append(sigmoid(np.bincount(row, value * weights[column], minlength=len(offsets) - 1)))
                yield pa.array(np.concatenate(out))

        return probability(text)


def fit(docs: DataFrame, labels: DataFrame, mine_rows: int = 3000, fit_rows: int = 5000, steps: int = 100) -> ToxicityModel:
    """Voters from labels(doc_id, toxic), their model from the votes of all docs, a classifier from its posteriors.

    `mine_rows` bounds the labelled rows of each class, `fit_rows` the rows the classifier learns from:
    a quarter likely toxic, the others not, chosen by a hash of doc_id among the learning rows.
    """
    spark = docs.sparkSession
    lexicons = [word_hashes(x) for x in LEXICONS.values()] + mined_lexicons(docs, labels, mine_rows)
    names = [f"v{k}" for k in range(len(lexicons) + len(PATTERNS))]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text"):
                table = votes(body, offsets, part.column("text"), lexicons)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(table[:, k]) for k in range(len(names))]], ["doc_id", *names])

    ballots = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(vote, "doc_id long, " + ", ".join(f"{c} tinyint" for c in names))
    order = F.struct(F.xxhash64("doc_id"), "doc_id")
    # the patterns are at most 3 ** voters, few in practice; each keeps fit_rows learning ids at most
    ballots = checkpointed(ballots.select("doc_id", F.concat_ws(",", *names).alias("pattern")))
    tallies = ballots.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").collect()
    if not tallies:
        return ToxicityModel(np.zeros(FEATURES), lexicons, None)
    table = np.array([[int(v) for v in r["pattern"].split(",")] for r in tallies], np.int8)
    model = label_model(table, np.array([r["n"] for r in tallies], float))
    belief = spark.createDataFrame(
        [(r["pattern"], float(p)) for r, p in zip(tallies, model.posterior(table))], "pattern string, belief double",
    )
    judged = ballots.where(learning(F.col("doc_id"))).join(belief, "pattern").select("doc_id", "belief")
    pick = lambda c, most: judged.where(c).orderBy(order).limit(most)
    chosen = pick("belief >= 0.5", fit_rows // 4).unionByName(pick("belief < 0.5", fit_rows * 3 // 4)).groupBy("doc_id").agg(F.max("belief").alias("belief"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows pairs of numbers
    row, feature, value, target = feature_rows(sample, ["belief"], features)
    n = len(target)
    # features that are rare in the sample, or about as frequent in either half, teach nothing
    held, bad = np.bincount(feature, minlength=FEATURES), np.bincount(feature, target[row], FEATURES)
    odds = (bad + 0.5) / (target.sum() + 1) / ((held - bad + 0.5) / (n - target.sum() + 1))
    telling = (held >= max(2, n // 1000)) & ((odds >= 4) | (odds <= 0.25))
    telling[ALWAYS] = True
    row, feature, value = (x[telling[feature]] for x in (row, feature, value))
    high = target >= 0.5
    weight = np.where(high, 0.4 / max(1, high.sum()), 0.6 / max(1, (~high).sum()))

    def gradient(w: np.ndarray) -> np.ndarray:
        miss = weight * (sigmoid(np.bincount(row, value * w[feature], minlength=n)) - target)
        return np.bincount(feature, value * miss[row], minlength=FEATURES) + 1e-4 * np.where(np.arange(FEATURES) == ALWAYS, 0, w)

    start = np.zeros(FEATURES)
    start[ALWAYS] = -2.0
    weights = adam(gradient, start, steps, 0.1)
    weights[ALWAYS] += 0.5 * np.log(model.prior / (1 - model.prior))  # the sample holds both halves alike, the corpus doesn't
    return ToxicityModel(weights, lexicons, model)
