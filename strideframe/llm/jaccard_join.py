"""Exact Jaccard self-join of word-shingle sets: skipping by blocks, prefix lists, answers derived from leaders.

1. Texts with equal sets form a class; only one set per class goes on.
2. Block skipping, from SKIPPING percent on (below, blocks are so short that nearly every set agrees with another
   somewhere: at five words and 80 percent 188,443 of 203,633 documents did, so nothing is gained). The global token order is cut into blocks by position, more than two linked sets of that
   size can differ in tokens; so they agree in at least one whole block (`block_keys`). The sets of such a key
   form a list; sets that agree with no other are skipped for good, and a bit sieve keeps their texts from travelling.
3. Prefix lists, below SKIPPING. Tokens are ordered by hash, with the HEAVY most frequent ones last, by
   count. Linked sets share a token among the first n - ceil(n * threshold) + 1 of each, and lists of these prefixes find every link.
   From SKIPPING on, parities of the tokens refuse pairs that differ in too many, before texts are read.
4. Answers of similar sets. In each list the member that enters earliest leads; every member is compared
   with it. That links most of a group of near copies, and leaves each set with a known distance to a leader.
5. What is left are pairs of a list that are not in one component yet. A list's entries form blocks by
   component, position and size; block pairs whose positions cannot leave enough overlap are skipped, the
   rest is expanded, and a pair that meets in several lists counts once. If both sets know their distance to one
   leader, the triangle inequality answers it when it can, by accepting or refusing; else the texts are read.

Sets are made from texts wherever they are read; only texts travel, compressed. Nothing is capped; leaders and
blocks only save comparisons.

Defined cases: null, empty and blank texts have an empty set and stay alone; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id with other texts are documents of their own, and rows without a
doc_id link with nothing. Classes and tokens are told by hashes of 63 and 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import textbytes as tb
from .phases import released, settled

BAND, SKIPPING = 1.5, 90
PAIR_BYTES = 1 << 20
HEAVY, NOTED = 50_000, 3
SIEVE, PIECE = 1 << 26, 1 << 16
LIGHT = 1
MARKS = ["m0", "m1", "m2", "m3"]
HALF = np.uint64(1)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each row's distinct word shingles, by row and token."""
    starts, ends, bounds = tb.words(body, offsets, tb.SOLID)
    hashes = tb.span_hashes(body, starts, ends)
    row, count = tb.rows_of(bounds), np.diff(bounds)
    first = tb.runs(hashes, size)
    whole = np.flatnonzero(row[: len(first)] == row[size - 1:]) if len(first) else np.zeros(0, np.int64)
    rows, tokens = [row[whole]], [first[whole]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            tokens.append(tb.mix(tb.runs(hashes, n)[bounds[short]] + np.uint64(n)))
    row, token = np.concatenate(rows), np.concatenate(tokens) >> HALF
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[fresh], token[fresh]


def bands(n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The one or two size bands in which a set of n tokens looks for partners: its own, and the next if sets
    of that band may be as near as the threshold."""
    own = np.floor(np.log(np.maximum(n, 1)) / np.log(BAND) + 1e-9).astype(np.int64)
    above = np.ceil(BAND ** (own + 1) - 1e-6)
    return own, n * 100 >= above * threshold


def blocks_in(band: np.ndarray, threshold: int) -> np.ndarray:
    """One more block than the tokens in which linked sets of the band (and of the next, by the threshold) can differ."""
    most = np.ceil(BAND ** (band + 1))
    return (2 * most * (100 - threshold) // (100 + threshold)).astype(np.int64) + 1


def block_keys(row: np.ndarray, token: np.ndarray, mixed: np.ndarray, m: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) so that two sets of a band that differ in fewer than m tokens, but differ, have a key in common.

    Tokens are hashes in order, so the m equal ranges of them are blocks by position. On a ring of m blocks with fewer than m
    differences there is a block without any whose successor has one at most. A block of more than LIGHT tokens is a key by its
    content; a lighter one agrees in too many sets, so its keys also hold the next block, whole and without each of its tokens.
    """
    m = np.where(m > 1, m, 0)  # with one block, sets that agree are equal
    use = np.flatnonzero(m[row] > 0)
    base = np.cumsum(m) - m
    place = ((token[use] >> np.uint64(31)) * m[row[use]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(base[row[use]] + place, minlength=int(m.sum()))
    ends = np.cumsum(count)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed[use], dtype=np.uint64)])
    content = sums[ends] - sums[ends - count]
    owner = np.repeat(np.arange(len(m)), m)
    place = np.arange(len(owner)) - base[owner]
    key = tb.mix(content + place.astype(np.uint64) * tb.BASE + band[owner].astype(np.uint64))
    light = np.flatnonzero(count <= LIGHT)
    after = base[owner[light]] + (place[light] + 1) % m[owner[light]]
    every = np.repeat(np.arange(len(light)), count[after])
    gone = mixed[use][(ends - count)[after][every] + np.arange(len(every)) - (np.cumsum(count[after]) - count[after])[every]]
    which, rest = np.concatenate([np.arange(len(light)), every]), np.concatenate([content[after], content[after][every] - gone])
    heavy = np.flatnonzero(count > LIGHT)
    return np.concatenate([owner[heavy], owner[light][which]]), np.concatenate([key[heavy], tb.mix(tb.mix(rest) + key[light][which])])


def signed(docs: DataFrame, size: int, threshold: int, keyed: bool) -> DataFrame:
    """Per row (doc_id, h, text): doc_id, h, n, two digests of the set and, if `keyed`, a key for every block of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text"):
                row, token = shingle_sets(body, offsets, size)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                n = np.diff(cuts)
                mixed = [tb.mix(token ^ salt) for salt in (tb.BASE, tb.BASE_INVERSE)]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(m, dtype=np.uint64)]) for m in mixed]
                digests = [(s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums]
                columns = [part.column("doc_id"), part.column("h"), pa.array(n.astype(np.int32)), *map(pa.array, digests)]
                if not keyed:
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "a", "b"])
                    continue
                own, next_ = bands(n, threshold)
                rows, keys = [], []
                for band, chosen in ((own, n > 0), (own + 1, (n > 0) & next_)):
                    own_rows, own_keys = block_keys(row, token, mixed[0], np.where(chosen, blocks_in(band, threshold), 0), band)
                    rows.append(own_rows)
                    keys.append(own_keys)
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                order = np.argsort(rows, kind="stable")
                ends = np.searchsorted(rows[order], np.arange(len(part) + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "a", "b", "keys"])

    return docs.mapInArrow(run, "doc_id long, h long, n int, a long, b long" + (", keys array<long>" if keyed else ""))


def sieve(rows: DataFrame) -> dict[int, bytes]:
    """SIEVE bits, by pieces of PIECE, of which those at the place of some (doc_id, h) are set: 8 MB at most, for any number of rows."""

    def piece(group: pa.Table) -> pa.Table:
        bits = np.zeros(PIECE, bool)
        bits[group.column("at").to_numpy()] = True
        return pa.table({"piece": group.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    place = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SIEVE))
    places = rows.select(F.floor(place / PIECE).cast("int").alias("piece"), (place % PIECE).cast("int").alias("at")).distinct()
    return {r["piece"]: bytes(r["bits"]) for r in places.groupBy("piece").applyInArrow(piece, "piece int, bits binary").collect()}


def sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`textbytes.packed` of all rows whose (doc_id, h) is among the wanted ones and few others, so that a join need not carry every text."""
    bits = np.zeros(SIEVE // 8, np.uint8)
    for k, piece in sieve(wanted).items():
        bits[k * PIECE // 8: (k + 1) * PIECE // 8] = np.frombuffer(piece, np.uint8)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("at").to_numpy()
        return batch.filter(pa.array(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    return tb.packed(rows.withColumn("at", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SIEVE))), "doc_id", "h", "at", held=held).drop("at")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(keys, return_inverse=True)
    return own, np.bincount(place, counts, len(own)).astype(np.int64)


def frequent_tokens(texts: DataFrame, size: int) -> np.ndarray:
    """At most HEAVY of the most frequent tokens, rarest first; counts come from tasks that saw a token NOTED times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            own, number = summed(every, np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)]))
            if len(own) > 1 << 20:  # rare ones go first; they only lose their place in the order
                some = np.argsort(-number, kind="stable")[: 1 << 19]
                own, number = own[some], number[some]
            return own, number

        for batch in tb.restored(batches):
            for _, body, offsets in tb.slices(batch, "text"):
                waiting.append(shingle_sets(body, offsets, size)[1].view(np.int64))
                held += len(waiting[-1])
                if held > 1 << 20:
                    (keys, counts), waiting, held = merged(), [], 0
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= NOTED]), pa.array(counts[counts >= NOTED])], ["t", "n"])

    found = texts.select("z").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "t").limit(HEAVY).toPandas()  # at most HEAVY pairs of numbers
    return top["t"].to_numpy(np.int64)[::-1].copy()


def prefixes(texts: DataFrame, heavy: np.ndarray, size: int, threshold: int) -> DataFrame:
    """c, n, pos and t of each set's first tokens: by hash, the frequent ones after all others, by count."""
    order = np.argsort(heavy)
    known, rank = heavy[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.restored(batches):
            for part, body, offsets in tb.slices(batch, "text"):
                row, token = shingle_sets(body, offsets, size)
                token = token.view(np.int64)
                n = np.bincount(row, minlength=len(part))
                late = np.zeros(len(token), np.int64)
                if len(known) and len(token):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    late = np.where(known[at] == token, rank[at] + 1, 0)
                token = token[np.lexsort((token, late, row))]
                pos = np.arange(len(token)) - (np.cumsum(n) - n)[row]
                keep = pos < (n - (n * threshold + 99) // 100 + 1)[row]
                yield pa.RecordBatch.from_arrays(
                    [part.column("c").take(pa.array(row[keep])), pa.array(n[row[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(token[keep])],
                    ["c", "n", "pos", "t"],
                )

    return texts.select("c", "z").mapInArrow(run, "c long, n int, pos int, t long")


def parities(texts: DataFrame, size: int) -> DataFrame:
    """c and MARKS numbers whose bits tell, by the low bits of the hash, of which tokens the set has an odd count."""
    wide = 64 * len(MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.restored(batches):
            for part, body, offsets in tb.slices(batch, "text"):
                row, token = shingle_sets(body, offsets, size)
                odd = np.bincount(row * wide + (token % np.uint64(wide)).astype(np.int64), minlength=len(part) * wide) & 1
                marks = np.packbits(odd.astype(bool).reshape(len(part), wide), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("c"), *[pa.array(marks[:, k].copy()) for k in range(len(MARKS))]], ["c", *MARKS])

    return texts.select("c", "z").mapInArrow(run, "c long, " + ", ".join(f"{k} long" for k in MARKS))


def unlike(x: str, y: str):
    """In how many bits the parities of two sets differ; they differ in as many tokens at least."""
    return sum((F.bit_count(F.col(f"{k}{x}").bitwiseXOR(F.col(f"{k}{y}"))) for k in MARKS[1:]), F.bit_count(F.col(f"{MARKS[0]}{x}").bitwiseXOR(F.col(f"{MARKS[0]}{y}"))))


def needed(n: str, m: str, threshold: int):
    """The least overlap of sets of n and m elements that reach the threshold."""
    return F.ceil((F.col(n) + F.col(m)) * threshold / (100 + threshold) - 1e-9)


def compared(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """pairs(x, y) with `apart`, the size of the symmetric difference, and whether they link; texts has (c, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()

        def sets(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            raw = [press.decompress(z) for z in packed]
            return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), size)

        for batch in batches:
            zx, zy = batch.column("zx").to_pylist(), batch.column("zy").to_pylist()
            wide = np.cumsum([zstandard.frame_content_size(x) + zstandard.frame_content_size(y) for x, y in zip(zx, zy)])
            first = 0
            while first < len(batch):
                # a text may be hundreds of times as long as its compressed form
                last = max(first + 1, int(np.searchsorted(wide, (wide[first - 1] if first else 0) + PAIR_BYTES, "right")))
                (row_x, x), (row_y, y) = sets(zx[first:last]), sets(zy[first:last])
                n = np.bincount(row_x, minlength=last - first), np.bincount(row_y, minlength=last - first)
                row, token = np.concatenate([row_x, row_y]), np.concatenate([x, y])
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                twice = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
                common = np.bincount(row[1:][twice], minlength=last - first)
                union = n[0] + n[1] - common
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), part.column("y"), pa.array(union - common), pa.array(100 * common >= threshold * union)], ["x", "y", "apart", "linked"],
                )
                first = last

    left, right = (texts.select(F.col("c").alias(s), F.col("z").alias(f"z{s}")) for s in ("x", "y"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y")
    return both.mapInArrow(run, "x long, y long, apart long, linked boolean")


def classed(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, h (hash of the text), n (set size) and `component`, its least doc_id, per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    skipping = threshold >= SKIPPING
    profiles = settled(signed(rows, size, threshold, skipping))
    filled = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = settled(
        filled.groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("n", "a", "b", F.col("a").alias("c"), "r.doc_id", "r.h"),
    )
    wanted = classes.select("doc_id", "h", "c")
    sizes = profiles
    if skipping:
        indexed = filled.select(F.explode("keys").alias("t"), F.col("a").alias("c"))
        agreeing = indexed.groupBy("t").agg(F.min("c").alias("l"), F.max("c").alias("q")).where("l <> q").select("t", "l")
        lists = settled(indexed.join(agreeing, "t"))
        wanted = settled(wanted.join(lists.select("c").distinct(), "c"))
        sizes = settled(profiles.select("doc_id", "h", "n", "a", "b"))
        released(profiles)
    # rows that repeat both doc_id and text would bring a class twice
    texts = settled((sieved(rows, wanted) if skipping else tb.packed(rows, "doc_id", "h")).join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("c", "z"))
    if skipping:
        sets = settled(parities(texts, size).join(classes.select("c", "n"), "c"))
        part = lambda side, n: sets.select(F.col("c").alias(side), F.col("n").alias(n), *[F.col(k).alias(f"{k}_{side}") for k in MARKS])
        led = lists.select(F.col("l").alias("x"), F.col("c").alias("y")).where("x <> y").distinct()
        led = led.join(part("x", "m"), "x").join(part("y", "n"), "y").where(unlike("_x", "_y") <= F.col("n") + F.col("m") - 2 * needed("n", "m", threshold))
        # a set of several rows is in a list several times
        members = sets.withColumn("pos", F.lit(0))
    else:
        postings = settled(prefixes(texts, frequent_tokens(texts, size), size, threshold))
        leaders = postings.groupBy("t").agg(F.min(F.struct("pos", "n", "c")).alias("l"), F.count("*").alias("k")).where("k > 1").drop("k")
        lists = settled(postings.join(leaders, "t"))
        released(postings)
        led = lists.select(F.col("l.c").alias("x"), F.col("c").alias("y"), F.col("l.n").alias("m"), "n", "pos", F.col("l.pos").alias("at")).where("x <> y")
        led = led.groupBy("x", "y", "m", "n").agg(F.min("pos").alias("pos"), F.min("at").alias("at"))  # their first common token
        led = led.where(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= needed("n", "m", threshold))
        members = lists.drop("l")
    led = led.where((F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold))
    first = settled(compared(led, texts, size, threshold))
    links = first.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    parts = settled(components(texts.select(F.col("c").alias("id")), links)).withColumnRenamed("id", "c")

    home = first.groupBy(F.col("y").alias("c")).agg(F.min(F.struct("apart", "x")).alias("h")).select("c", F.col("h.x").alias("leader"), F.col("h.apart").alias("far"))
    rows = members.join(parts, "c").join(home, "c", "left")
    rows = rows.withColumn("block", F.struct("component", F.floor(F.log2(F.col("pos") + 1)), F.floor(F.log("n") / F.log(F.lit(1.05)))))
    if skipping:
        known = settled(rows)
        rows = lists.select("t", "c").distinct().join(known, "c")
    marks = MARKS if skipping else []
    blocks = rows.groupBy("t", "component", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.count("*").alias("k"), *[F.min(k).alias(k) for k in marks],
    )
    split = blocks.groupBy("t").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("t")
    blocks = settled(blocks.join(split, "t"))
    side = lambda df, s, names, at=("t",): df.select(*at, *[F.col(c).alias(f"{c}_{s}") for c in names])
    names = ["component", "block", "low", "high", "rest", "k", *marks]
    open_ = side(blocks, "x", names).join(side(blocks, "y", names), "t").where(
        (F.col("component_x") < F.col("component_y")) & (F.col("high_x") * 100 >= F.col("low_y") * threshold) & (F.col("high_y") * 100 >= F.col("low_x") * threshold)
        & (F.least("rest_x", "rest_y") >= needed("low_x", "low_y", threshold)),
    )
    if skipping:  # most blocks hold one set
        open_ = open_.where((F.col("k_x") + F.col("k_y") > 2) | (unlike("_x", "_y") <= F.col("low_x") + F.col("low_y") - 2 * needed("low_x", "low_y", threshold)))
        # sets of two blocks meet once, however many lists these share, and the smaller block is expanded first
        less = F.col("k_x") <= F.col("k_y")
        ends = [F.when(less, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("block_x", "block_y"), ("block_y", "block_x"))]
        open_, rows, at = settled(open_.select(*ends).distinct()), known, []
    else:
        rows, at = settled(rows.join(split, "t").drop("component")), ["t"]
        open_ = open_.select("t", "block_x", "block_y")
    released(lists)
    names = ["c", "n", "pos", "block", "leader", "far", *marks]
    # at a pair's first common token most is left of both; a later one lets no other pair through
    pairs = open_.join(side(rows, "x", names, at), [*at, "block_x"]).join(side(rows, "y", names, at), [*at, "block_y"]).where(
        F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= needed("n_x", "n_y", threshold),
    )
    allowed = F.col("n_x") + F.col("n_y") - 2 * needed("n_x", "n_y", threshold)
    if skipping:
        pairs = pairs.where(unlike("_x", "_y") <= allowed)
    same = F.col("leader_x") == F.col("leader_y")
    pairs = pairs.select(
        F.col("c_x").alias("x"), F.col("c_y").alias("y"), F.coalesce(same & (F.col("far_x") + F.col("far_y") <= allowed), F.lit(False)).alias("near"),
        F.coalesce(same & (F.abs(F.col("far_x") - F.col("far_y")) > allowed), F.lit(False)).alias("off"),
    ).where("NOT off").distinct()
    pairs = settled(pairs)
    released(rows, blocks, *([open_] if skipping else []))
    late = compared(pairs.where("NOT near"), texts, size, threshold).where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    late = settled(late.unionByName(pairs.where("near").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    if not late.isEmpty():
        # only components are joined now, and there are fewer of them than sets
        lift = lambda side: parts.select(F.col("c").alias(side), F.col("component").alias(f"{side}_part"))
        bridges = late.join(lift("a"), "a").join(lift("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
        roots = components(parts.select(F.col("component").alias("id")).distinct(), bridges).select(F.col("id").alias("component"), F.col("component").alias("root"))
        parts = parts.join(roots, "component").select("c", F.col("root").alias("component"))

    own = classes.join(parts, "c", "left").select("n", "a", "b", "doc_id", F.coalesce("component", "c").alias("piece"))
    least = own.groupBy("piece").agg(F.min("doc_id").alias("component"))
    lowest = settled(own.join(least, "piece").select("n", "a", "b", "component"))
    released(first, pairs, late, texts, *([sets] if skipping else []))
    return sizes.join(lowest, ["n", "a", "b"], "left").select("doc_id", "h", "n", F.coalesce("component", "doc_id").alias("component"))


def joined(docs: DataFrame, size: int = 3, threshold: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links of `threshold` percent) per row."""
    return classed(docs, size, threshold).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, size: int = 3, threshold: int = 90) -> DataFrame:
    """One row of each component, as it is: the one of the least doc_id, and of its texts the one of the least hash.
    Rows with an empty set or without a doc_id stay."""
    found = settled(classed(docs, size, threshold).where("n > 0 AND doc_id IS NOT NULL").groupBy("component", "doc_id", "h").agg(F.count("*").alias("k")))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    marked = found.join(first, "component").select(
        F.col("doc_id").alias("id"), F.col("h").alias("v"), (F.struct("doc_id", "h") != F.col("r")).alias("gone"), (F.col("k") > 1).alias("several"),
    ).where("gone OR several")
    marked = settled(marked)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"))
    kept = keyed.join(marked.select("id", "v"), ["id", "v"], "left_anti")
    several = keyed.join(marked.where("NOT gone").select("id", "v"), ["id", "v"], "left_semi").groupBy("id", "v").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(several.select("row")).select("row.*")
