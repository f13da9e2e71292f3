"""Benchmark passages in training texts, found by suffix arrays of the training shards.

Every slice of texts that a task reads is a shard. Its word suffixes form a suffix array; each suffix of
each test item is looked up by binary search, one word deeper per step, which gives every place where a
window of the item occurs and how far the match goes on from there. A suffix whose first window isn't any
item's window cannot match one and is left out of the array, so its size follows the shared passages.

The items are read in blocks of bounded size; the texts pass all blocks in one scan, without a shuffle.
Words are compared by 64-bit hashes of their bytes.

Defined cases: a null or empty text has no words; an item without words, or with a null id or text, has no
window; repeated items and rows each count on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

BLOCK_BYTES = 4 << 20
FINDING = (
    "struct<n_words: bigint, ranges: array<int>, items: array<bigint>, longest: array<int>, doc_from: array<int>, item_from: array<int>>"
)


@dataclass
class Block:
    """Test items as word hashes, and the suffixes that start a window."""

    ids: np.ndarray
    letters: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    known: dict[int, np.ndarray]
    bits: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], window: int) -> Block:
        raw = [t.encode() for t in texts]
        body = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts, ends, bounds = tb.words(body, offsets, tb.ALNUM)
        letters = tb.span_hashes(body, starts, ends)
        n = np.diff(bounds)
        length = np.minimum(n, window)
        windows = np.where(n > 0, n - length + 1, 0)
        item = np.repeat(np.arange(len(n)), windows)
        first = np.concatenate([[0], np.cumsum(windows)])[:-1]
        start = np.arange(len(item)) - first[item] + bounds[:-1][item]
        known, bits = {}, {}
        for m in np.unique(length[item]):
            own = start[length[item] == m]
            known[int(m)] = np.unique(tb.runs(letters, int(m))[own])
            table = np.zeros(1 << 20, bool)
            table[(known[int(m)] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            bits[int(m)] = table
        return cls(np.array(ids, np.int64), letters, bounds, item, start, length[item], known, bits)


def bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Per query, the first place in column[low:high] that isn't below (or, with `after`, is above) its word."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(column) - 1)
        value = column[middle]
        below = (value <= wanted) if after else (value < wanted)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def suffix_array(letters: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes `at` in the order of their first `depth` words, and in that order the words at each depth.

    `ends` is where each suffix's text ends; past it the word is 0. Ties are refined word by word.
    """
    def word(places: np.ndarray, stops: np.ndarray, d: int) -> np.ndarray:
        return np.where(places + d < stops, letters[np.minimum(places + d, len(letters) - 1)], np.uint64(0))

    order = np.argsort(word(at, ends, 0), kind="stable")
    group = np.zeros(len(at), np.int64)
    for d in range(depth):
        here = word(at[order], ends[order], d)
        again = np.lexsort((here, group))
        order, here, group = order[again], here[again], group[again]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (here[1:] != here[:-1])
        group = np.cumsum(fresh) - 1
        if fresh.all():
            break
    return order, [word(at[order], ends[order], d) for d in range(depth)]


def shard_matches(block: Block, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(row, first word, window length, item, matched words, item word) of every occurrence of a window."""
    places = []
    for m, known in block.known.items():
        run = tb.runs(letters, m)
        maybe = np.flatnonzero(block.bits[m][(run & np.uint64((1 << 20) - 1)).astype(np.int64)])
        places.append(maybe[np.isin(run[maybe], known)])
    at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    if not len(at):
        return None
    row = np.searchsorted(bounds, at, "right") - 1
    depth = int(np.diff(block.bounds).max())
    order, columns = suffix_array(letters, bounds[row + 1], at, depth)
    stop = block.bounds[block.item + 1]
    low, high = np.zeros(len(block.start), np.int64), np.full(len(block.start), len(at), np.int64)
    live = np.arange(len(block.start))
    found, deeper = [], []
    for d in range(depth):
        live = live[block.start[live] + d < stop[live]]
        if not len(live):
            break
        wanted = block.letters[block.start[live] + d]
        a = bound(columns[d], low[live], high[live], wanted, False)
        b = bound(columns[d], low[live], high[live], wanted, True)
        some = a < b
        live = live[some]
        low[live], high[live] = a[some], b[some]
        done = live[block.length[live] == d + 1]
        if len(done):
            size = high[done] - low[done]
            query = np.repeat(done, size)
            first = np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
            found.append((query, low[query] + np.arange(len(query)) - first))
        deeper.append((d + 1, live, low[live].copy(), high[live].copy()))
    if not found:
        return None
    query, entry = (np.concatenate(x) for x in zip(*found))
    length = block.length[query].copy()
    a, b = np.zeros(len(block.start), np.int64), np.zeros(len(block.start), np.int64)
    for d, alive, lows, highs in deeper:
        a[:], b[:] = 0, 0
        a[alive], b[alive] = lows, highs
        length = np.where((entry >= a[query]) & (entry < b[query]) & (d > length), d, length)
    place = at[order[entry]]
    return (
        row[order[entry]], place - bounds[row[order[entry]]], block.length[query], block.item[query], length,
        block.start[query] - block.bounds[block.item[query]],
    )


def merged(ranges: np.ndarray) -> list[int]:
    """Sorted (from, to) pairs without overlaps, flat."""
    pairs = ranges.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.column_stack([pairs[fresh, 0], np.concatenate([reach[fresh[1:] - 1], reach[-1:]])]).ravel().tolist()


def finding(text: Column, block: Block, before: Column | None) -> Column:
    """What one block finds in each text, added to what the blocks before it found."""

    @F.arrow_udf(FINDING)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = None
        for texts, earlier in batches:
            batch = pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], ["text", "n"])
            out = []
            for part, body, offsets in tb.slices(batch, "text"):
                starts, ends, bounds = tb.words(body, offsets, tb.ALNUM)
                got = shard_matches(block, tb.span_hashes(body, starts, ends), bounds)
                by_row = {}
                if got:
                    order = np.argsort(got[0], kind="stable")
                    cuts = np.flatnonzero(np.diff(got[0][order])) + 1
                    for piece in np.split(order, cuts):
                        by_row[int(got[0][piece[0]])] = [x[piece] for x in got[1:]]
                base = part.column("n")[0].as_py()
                for k, n in enumerate(np.diff(bounds).tolist()):
                    old = earlier[base + k].as_py() if pa.types.is_struct(earlier.type) else None
                    row = old or {"n_words": n, "ranges": [], "items": [], "longest": [], "doc_from": [], "item_from": []}
                    if k in by_row:
                        at, m, item, words, item_at = by_row[k]
                        row["ranges"] = merged(np.concatenate([np.array(row["ranges"], np.int64), np.column_stack([at, at + m]).ravel()]))
                        best = np.lexsort((at, -words, item))
                        _, first = np.unique(item[best], return_index=True)
                        chosen = best[first]
                        for name, values in (("items", block.ids[item[chosen]]), ("longest", words[chosen]), ("doc_from", at[chosen]), ("item_from", item_at[chosen])):
                            row[name] = row[name] + values.tolist()
                    out.append(row)
            kind = kind or pa.struct([
                ("n_words", pa.int64()), ("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())),
                ("longest", pa.list_(pa.int32())), ("doc_from", pa.list_(pa.int32())), ("item_from", pa.list_(pa.int32())),
            ])
            yield pa.array(out, kind)

    return find(text, F.lit(0) if before is None else before)


def blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The test items (item_id, text), `block_bytes` at a time; there is always one block, if an empty one."""
    ids, texts, size, any_ = [], [], 0, False
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("i"), "text").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["text"])
        size += len(r["text"]) * 2
        if size >= block_bytes:
            yield Block.of(ids, texts, window)
            ids, texts, size, any_ = [], [], 0, True
    if ids or not any_:
        yield Block.of(ids, texts, window)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = 10, name: str = "_found") -> DataFrame:
    """docs and a struct `name`: n_words, ranges of hit words (from, to, ...), item ids with occurring windows,
    and for each of these the longest verbatim match, where it starts in the text and where in the item."""
    out, seen = docs, False
    for block in blocks(benchmark, window):
        out = out.withColumn(name, finding(F.col("text"), block, F.col(name) if seen else None))
        seen = True
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, as they are, in which no window of any item occurs."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return scanned(row, benchmark, window, "found").where(F.size("found.items") == 0).select("row.*")
