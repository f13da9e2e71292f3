"""Exact ranked search without random access (NRA) over impact-sorted lists, in shards of the corpus.

1. One pass finds every document's length and its occurrences of terms that some item asks for; these postings
   are written once. Counts of documents per term, and the corpus' sizes, are sums over them.
2. A shard is a run of written postings of bounded size. In it, lists hold a term's documents by falling impact.
3. For an item, its lists are read from the top in steps of falling impact. A document's lower bound is the sum of
   what was read of it; its upper bound adds, for every list in which it was not met, what that list shows next.
   Documents that were never met have the sum of what all lists show next as their upper bound. Reading goes on
   until no other document can reach the tenth lower bound, ties included, and both bounds of all that can
   are equal: then membership, order and scores are final.
4. Shards' answers meet per item, and the best of them stay; Spark cuts them per task before they are shuffled.

Items are dealt to blocks of about `block` characters; a block's terms go to the tasks, and blocks are searched one
after the other, so that neither the driver nor a task holds all items of a large table. No document is skipped.

Defined cases: null texts, and texts without a term, have no terms and are never found; an item without terms, or
whose terms no document has, gets no rows. Rows that repeat a doc_id are ranked on their own; documents without
a doc_id come after others of the same score. Items that repeat an item_id with another text are ranked on
their own under the same item_id; repeated rows count once. Other columns are not read. Terms are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .phases import settled

TOP = 10
BLOCK = 8_000_000
SHARD = 1 << 21
FIRST_READ = 4_096
LAST = np.iinfo(np.int64).max


def item_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(item, term hash) of every term occurrence of a few texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    items, terms, first = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for part, body, offsets in tb.slices(batch, "text"):
        starts, ends, bounds = tb.words(body, offsets, tb.ALNUM)
        items.append(first + tb.rows_of(bounds))
        terms.append(tb.span_hashes(body, starts, ends))
        first += len(part)
    return np.concatenate(items), np.concatenate(terms)


class Asked:
    """The items of a block: their distinct terms, and each item's terms with their repeats."""

    def __init__(self, rows: list[tuple]):
        self.names = [r[0] for r in rows]
        item, term = item_terms([r[1] for r in rows])
        self.terms, number = np.unique(term, return_inverse=True)
        pairs, times = np.unique(np.column_stack([item, number]), axis=0, return_counts=True)
        cut = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.items = [(pairs[x:y, 1], times[x:y]) for x, y in zip(cut, cut[1:])]


def postings(docs: DataFrame, asked) -> DataFrame:
    """doc_id, its number of terms, and the numbers and counts of asked terms, for documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value.terms
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text"):
                starts, ends, bounds = tb.words(body, offsets, tb.ALNUM)
                hashes, row = tb.span_hashes(body, starts, ends), tb.rows_of(bounds)
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                met = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                both, times = np.unique(row[met] * np.int64(len(terms)) + at[met], return_counts=True)
                width = max(len(terms), 1)
                cut = np.searchsorted(both // width, np.arange(len(part) + 1)).astype(np.int32)
                n = np.diff(bounds)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in ((both % width).astype(np.int32), times.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def holders(lists: DataFrame) -> DataFrame:
    """(term, df): documents per asked term, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    return lists.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def length_part(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms."""
    if int(n.max(initial=0)) * 75 * documents < LAST:
        return 25 + 75 * n * documents // terms
    return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)


class Shard:
    """Impact-sorted lists of some documents; `first[t]` to `first[t + 1]` is the list of term t."""

    def __init__(self, rows: list[pa.RecordBatch], weight: np.ndarray, documents: int, all_terms: int):
        together = pa.Table.from_batches(rows)
        self.doc_id = pa.concat_arrays(together.column("doc_id").chunks)
        self.order = self.doc_id.fill_null(LAST).to_numpy()
        count = np.concatenate([np.diff(r.column("terms").offsets.to_numpy()) for r in rows])
        term, tf = (np.concatenate([r.column(c).flatten().to_numpy() for r in rows]) for c in ("terms", "tf"))
        doc = np.repeat(np.arange(len(count)), count)
        m = length_part(together.column("n").to_numpy(), documents, all_terms)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        by = np.lexsort((-impact, term))
        self.doc, self.impact = doc[by], impact[by]
        self.first = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.read = 0  # entries read for the last item

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, by reading the terms' lists from the top."""
        size = self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.first[terms][which]
        impact = self.impact[place] * times[which]
        # one falling order over all lists: reading up to a place of it reads every list down to the same impact
        turn = np.argsort(-impact, kind="stable")
        impact, which, doc = impact[turn], which[turn], self.doc[place[turn]]
        lower, read, upto = np.zeros(len(self.order), np.int64), 0, min(FIRST_READ, len(turn))
        while True:
            np.add.at(lower, doc[read:upto], impact[read:upto])
            self.read = read = upto
            shown = np.zeros(len(terms), np.int64)
            shown[which[read:][::-1]] = impact[read:][::-1]  # what each list shows next
            unmet = int(shown.sum())
            upper = lower + unmet
            np.subtract.at(upper, doc[:read], shown[which[:read]])
            bar = int(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) > k else 0
            if read == len(turn) or (bar > 0 and unmet < bar):
                rivals = np.flatnonzero((upper >= max(bar, 1)))
                if (upper[rivals] == lower[rivals]).all():
                    chosen = rivals[np.lexsort((self.order[rivals], -lower[rivals]))][:k]
                    return chosen, lower[chosen]
            upto = min(2 * read, len(turn))


def shard_answers(lists: DataFrame, asked, statistics, k: int, shard: int) -> DataFrame:
    """(item, doc_id, score): the k best of every shard for every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value.items
        weight, documents, terms = statistics.value

        def answered(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Shard(rows, weight, documents, terms)
            number, found, scores = [], [], []
            for i, (wanted, times) in enumerate(items):
                if len(wanted):
                    doc, score = own.best(wanted, times, k)
                    number.append(np.full(len(doc), i))
                    found.append(doc)
                    scores.append(score)
            if number:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(number).astype(np.int32)), own.doc_id.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))],
                    ["item", "doc_id", "score"],
                )

        rows, held = [], 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows.append(batch.slice(at, 4096))
                held += len(rows[-1].column("terms").flatten()) + len(rows[-1])
                if held > shard:
                    yield from answered(rows)
                    rows, held = [], 0
        if rows:
            yield from answered(rows)

    return lists.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // block) + 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    answers = None
    for b in range(blocks):
        own = wanted.where(number == b) if blocks > 1 else wanted
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # some `block` characters
        part = Asked(rows)
        asked = spark.sparkContext.broadcast(part)
        lists = settled(postings(texts, asked))
        documents, terms = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(part.terms), np.int64)
        for r in holders(lists).collect():  # a number per term of the block
            df[r["term"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        statistics = spark.sparkContext.broadcast((weight, documents, terms))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = shard_answers(lists, asked, statistics, k, shard).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        named = best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        named = settled(named) if blocks > 1 else named
        answers = named if answers is None else answers.unionByName(named)
    return answers


#: The same ranking by full sums; HUGEINT keeps n * N * 75 whole.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), s AS (SELECT count(*) AS big, sum(len(w)) AS total FROM d WHERE len(w) > 0),
 o AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
 p AS (SELECT doc_id, n, t, count(*) AS tf FROM o WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
 f AS (SELECT t, floor(1000 * ln((2 * any_value(big) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t),
 i AS (
  SELECT doc_id, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75::HUGEINT * n * big) // total)::BIGINT))) AS impact
  FROM p JOIN f USING (t), s
), r AS (
  SELECT item_id, doc_id, sum(times * impact) AS score FROM (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL) JOIN i USING (t)
  GROUP BY item_id, doc_id HAVING sum(times * impact) > 0
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM k WHERE rank <= 10
"""
