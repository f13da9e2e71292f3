"""Repeated byte strings of the corpus, by a prefix-free parse and the order classes of its suffixes.

Whether the `LENGTH` bytes at a position occur again is a question to the corpus suffix order: do they
share a class of that order at depth LENGTH. Sorting every suffix of the corpus is what the parse avoids.

1. Triggers. The trigger of a position is the least rolling hash of `WIDTH` bytes among the places where
   a string of CONTEXT bytes, starting there, still lies inside the position's LENGTH bytes. Equal strings
   have equal triggers at equal offsets. Consecutive positions with one trigger are a phrase; phrases, each
   with the LENGTH bytes after it, overlap by what the next trigger needs, so none is a prefix of another.
2. Dictionary. Phrases are named by a digest of all their suffixes; equal names are one entry, and every
   suffix of an entry that occurs twice is repeated. On repetitive text this settles nearly everything.
3. Parse. A suffix continues with its trigger's CONTEXT bytes, so only entries with the same context can
   share a suffix. Where a context has several entries, they are compared once per entry and not once per
   occurrence, in windows of WINDOW starts counted back from the trigger. The bytes of all starts of a window
   are its full name: windows of one full name are repeated. The bytes that all its starts have in common are
   its core: windows with a core of their own share no suffix.
4. Suffixes. Where a core has several full names, one of them new, the suffixes of one window per name are put
   into their order classes; classes with two members are repeated.
5. The bytes that repeated strings cover are cut out of the texts.

No suffix array of the dictionary or of the parse is built: classes are told by digests of the bytes and not by their
rank, since only equality at depth LENGTH is asked for and ranks would need two more global sorts.

Defined cases: a null text is empty; texts shorter than LENGTH keep everything; overlapping occurrences
count; rows that repeat a doc_id are told apart by their texts, and repeated rows are copies of each other.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .phases import released, settled

LENGTH, CONTEXT, WIDTH = 200, 64, 16
REACH = LENGTH - CONTEXT
WINDOW = 17
PLACE_BITS = np.uint64(28)
PIECE = 1 << 16  # bytes of text at once; the arrays of so many stay in a core's cache


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tb.mix(left * tb.BASE + right)


def ahead(values: np.ndarray, n: int) -> np.ndarray:
    """values[i + n], and 0 past the end."""
    out = np.zeros_like(values)
    if n < len(values):
        out[: len(values) - n] = values[n:]
    return out


def rolling(body: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, hashes of so many bytes from every place on, by doubling."""
    by = {1: tb.mix(tb.LETTERS[body])}
    for n in (1, 2, 4, 8, 16, 32, 64):
        by[2 * n] = joined_hash(by[n], ahead(by[n], n))
    out = []
    for size in sizes:
        powers = [n for n in sorted(by, reverse=True) if size & n]
        hashed, done = by[powers[0]], powers[0]
        for n in powers[1:]:
            hashed, done = joined_hash(hashed, ahead(by[n], done)), done + n
        out.append(hashed)
    return out


def valid_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from which LENGTH bytes lie in one text, and their rows."""
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return offsets[:-1][row] + np.arange(len(row)) - first[row], row


def phrases(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, from, to, context, name) of every phrase; from and to count starts within the row's text."""
    at, row = valid_starts(offsets)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    narrow, context, whole = rolling(body, WIDTH, CONTEXT, LENGTH)
    # the place in the low bits: the least hash, and the first place of equals
    least = (narrow >> PLACE_BITS << PLACE_BITS) | np.arange(len(body), dtype=np.uint64)
    for n in (1, 2, 4, 8, 16, 32, 64):
        moved = ahead(least, n)
        moved[len(body) - n:] = np.iinfo(np.uint64).max
        least = np.minimum(least, moved)
    rest = REACH + 1 - 128
    moved = ahead(least, rest)
    moved[max(0, len(body) - rest):] = np.iinfo(np.uint64).max
    least = np.minimum(least, moved)
    trigger = (least[at] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    stop = np.append(first[1:], len(at))
    step = (np.arange(len(at)) - np.repeat(first, stop - first)).astype(np.uint64)
    name = np.add.reduceat(tb.mix(whole[at] + step * tb.BASE_INVERSE), first)
    start = offsets[:-1][row[first]]
    return row[first], at[first] - start, at[stop - 1] + 1 - start, context[trigger[first]], name


def phrase_table(docs: DataFrame, located: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text", PIECE):
                row, a, b, context, name = phrases(body, offsets)
                columns = [pa.array(context.view(np.int64)), pa.array(name.view(np.int64))]
                if located:
                    columns += [part.column(n).take(pa.array(row)) for n in ("id", "h")] + [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["context", "name", "id", "h", "a", "b"][: len(columns)])

    return docs.mapInArrow(run, "context long, name long" + (", id long, h long, a int, b int" if located else ""))


def listed(part: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, from, to, context, k) of the ranges in `entries`; from and to count in the slice."""
    entries = part.column("entries")
    row = np.repeat(np.arange(len(part)), np.diff(entries.offsets.to_numpy()))
    a, b, context, k = (entries.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "context", "k"))
    start = offsets[:-1][row]
    return row, a + start, b + start, context, np.minimum(k, 2).astype(np.int32)


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each of count[i] items of i, and its number among them."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def window_table(texts: DataFrame) -> DataFrame:
    """Full name and core of every window of the entries in `entries` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.restored(batches):
            for part, body, offsets in tb.slices(batch, "text", PIECE):
                contexts, whole, core = rolling(body, CONTEXT, LENGTH, LENGTH - WINDOW + 1)
                row, a, b, context, k = listed(part, offsets)
                # an earlier place with the trigger's context would have been the trigger
                trigger = b - 1
                for step in range(REACH, -1, -1):
                    here = np.minimum(b - 1 + step, len(body) - 1)
                    trigger = np.where(contexts[here].view(np.int64) == context, here, trigger)
                near, far = trigger - b + 1, trigger - a
                entry, n = spread(far // WINDOW - near // WINDOW + 1)
                n = n + near[entry] // WINDOW
                near, far = np.maximum(near[entry], n * WINDOW), np.minimum(far[entry], n * WINDOW + WINDOW - 1)
                trigger = trigger[entry]
                first, last = trigger - far, trigger - near
                name = tb.mix(joined_hash(whole[first], whole[last]) ^ (near * LENGTH + far).astype(np.uint64))
                middle = tb.mix(core[trigger - n * WINDOW] + n.astype(np.uint64))
                rows, start = pa.array(row[entry]), offsets[:-1][row[entry]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[entry]), pa.array(middle.view(np.int64)), pa.array(name.view(np.int64)), part.column("id").take(rows), part.column("h").take(rows),
                     pa.array((first - start).astype(np.int32)), pa.array((last + 1 - start).astype(np.int32)), pa.array(k[entry])],
                    ["context", "core", "name", "id", "h", "a", "b", "k"],
                )

    return texts.mapInArrow(run, "context long, core long, name long, id long, h long, a int, b int, k int")


def suffix_table(texts: DataFrame) -> DataFrame:
    """Order class of every suffix of the ranges in `entries` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.restored(batches):
            for part, body, offsets in tb.slices(batch, "text", PIECE):
                (whole,) = rolling(body, LENGTH)
                row, a, b, context, k = listed(part, offsets)
                entry, step = spread(b - a)
                at = a[entry] + step
                rows = pa.array(row[entry])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[entry]), pa.array(whole[at].view(np.int64)), part.column("id").take(rows),
                     part.column("h").take(rows), pa.array((at - offsets[:-1][row[entry]]).astype(np.int32)), pa.array(k[entry])],
                    ["context", "s", "id", "h", "at", "k"],
                )

    return texts.mapInArrow(run, "context long, s long, id long, h long, at int, k int")


def covered(ranges: np.ndarray) -> np.ndarray:
    """Disjoint, sorted (from, to) rows of the bytes that strings at starts in `ranges` cover; touching ones merged."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    ends = np.maximum.accumulate(ranges[:, 1] - 1 + LENGTH)
    fresh = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > ends[:-1]]))
    return np.column_stack([ranges[fresh, 0], np.append(ends[fresh[1:] - 1], ends[-1])])


def cut(texts: DataFrame) -> DataFrame:
    """Per text, what goes and a digest of what stays; `kept` holds the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.restored(batches):
            for part, body, offsets in tb.slices(batch, "text"):
                removed, spans, kept = [], [], []
                for k, found in enumerate(part.column("ranges")):
                    own = body[offsets[k]: offsets[k + 1]]
                    runs = np.zeros((0, 2), np.int64)
                    if found.is_valid and len(found):
                        flat = found.values
                        runs = covered(np.column_stack([flat.field("a").to_numpy(), flat.field("b").to_numpy()]).astype(np.int64))
                    stay = np.concatenate([[0], runs.ravel(), [len(own)]]).reshape(-1, 2)
                    kept.append(b"".join(own[a:b].tobytes() for a, b in stay))
                    removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                    spans.append(len(runs))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    contexts = phrase_table(rows, False).groupBy("context").agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
    # written, so that the join deals both sides itself and can split the phrases of a frequent context
    contexts = settled(contexts.where("n > 1").select("context", (F.col("low") == F.col("high")).alias("settled")))
    seen = settled(phrase_table(rows, True).join(contexts, "context"))
    released(contexts)
    whole = seen.where("settled").select("id", "h", "a", "b")
    # one text stands for all occurrences of an entry; contexts all of whose entries occur twice are settled too
    open_ = seen.where("NOT settled").groupBy("context", "name").agg(F.count("*").alias("k"), F.min(F.struct("id", "h", "a", "b")).alias("e"))
    single_in = open_.groupBy("context").agg(F.min("k").alias("least")).where("least = 1").select("context")
    entries = open_.join(single_in, "context").groupBy("e.id", "e.h").agg(F.collect_list(F.struct("e.a", "e.b", "context", "k")).alias("entries"))
    # entries of a row that is there twice have k > 1, so that it is read twice changes no count that matters
    once = tb.packed(rows, "id", "h").join(entries, ["id", "h"])
    windows = settled(window_table(once))
    classes = settled(windows.groupBy("context", "core", "name").agg(F.sum("k").alias("k"), F.min(F.struct("id", "h", "a", "b")).alias("e")))
    same = windows.where("k = 1").join(classes.where("k > 1").select("context", "core", "name"), ["context", "core", "name"]).select("id", "h", "a", "b")
    mixed = classes.groupBy("context", "core").agg(F.count("*").alias("n"), F.min("k").alias("least")).where("n > 1 AND least = 1").select("context", "core")
    parts = classes.join(mixed, ["context", "core"]).groupBy("e.id", "e.h").agg(F.collect_list(F.struct("e.a", "e.b", "context", "k")).alias("entries"))
    suffixes = settled(suffix_table(tb.packed(rows, "id", "h").join(parts, ["id", "h"])))
    repeated = suffixes.groupBy("context", "s").agg(F.sum("k").alias("n")).where("n > 1").select("context", "s")
    single = suffixes.where("k = 1").join(repeated, ["context", "s"]).select("id", "h", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    single = settled(single.unionByName(same).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("r")))
    released(windows, classes, suffixes)
    del windows, classes, same, mixed, parts, suffixes, repeated
    several = seen.where("NOT settled").join(open_.where("k > 1").select("context", "name"), ["context", "name"]).select("id", "h", "a", "b")
    ranges = whole.unionByName(several).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("r")).unionByName(single)
    ranges = settled(ranges.groupBy("id", "h").agg(F.flatten(F.collect_list("r")).alias("ranges")))
    released(seen, single)
    del seen, whole, open_, several, single, single_in, entries, once
    gc.collect()
    return cut(tb.packed(rows, "doc_id", "id", "h").join(ranges, ["id", "h"], "left").select("doc_id", "z", "ranges"))
