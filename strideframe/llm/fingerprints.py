"""MinHash fingerprints of documents, their likeness, and near copies by bands of the fingerprint.

A fingerprint holds, for each of PERMUTATIONS universal hashes h(x) = (a x + b mod 2^64) / 2^32, the least value
over the hashes of a text's shingles: five consecutive words (runs of anything but blank and 0x09 to 0x0D, A-Z
lower-cased). A text of fewer words has the runs of five of its bytes as shingles, or all of its bytes. The
share of equal places of two fingerprints, their likeness, estimates the Jaccard similarity of the shingle sets.

`compared_to_edits` needs the document that follows by doc_id. Rows are dealt to ranges of (doc_id, text hash) whose
bounds are collected (one pair per range); the row that starts a range is dealt to the range before as well,
so that every range, read in order, has all it needs, and each text is shuffled once, compressed.

`near_copies` joins bands of the fingerprints. Rows with equal shingle sets are one class. In every band's group the
class of the least number leads and the others are compared with it; after that only classes of one group
that are in different components are compared. Similarity is always that of the sets themselves. A pair of
similarity 0.8 shares no band with a probability under 10^-7; nothing is capped.

Defined cases: a null text is empty; empty texts have no shingle and one fingerprint of their own, are like each
other (1) and unlike all others (0), and are no near copies. Rows of one doc_id follow each other by text hash, equal
rows in any order; rows without a doc_id come first. With one row, it follows itself. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import textbytes as tb
from .jaccard_join import compared, shingle_sets
from .phases import released, settled

WORDS, THRESHOLD = 5, 80
PERMUTATIONS, BANDS = 128, 32
PIECE, GROUP = 1 << 16, 1 << 20
FULL = np.uint32(0xFFFFFFFF)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the universal hashes."""
    rng = np.random.default_rng(12)
    a, b = rng.integers(0, 2**63, (2, PERMUTATIONS), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, PERMUTATIONS), dtype=np.uint64)
    return a | np.uint64(1), b


def shingles(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds of each row's) of the shingles of some texts, repeats included."""
    starts, ends, bounds = tb.words(body, offsets, tb.SOLID)
    hashes, row = tb.span_hashes(body, starts, ends), tb.rows_of(bounds)
    runs = tb.runs(hashes, WORDS)
    whole = np.flatnonzero(row[: len(runs)] == row[WORDS - 1:]) if len(runs) else np.zeros(0, np.int64)
    rows, values = [row[whole]], [runs[whole]]
    letters = tb.FOLDED[body]
    for k in np.flatnonzero((np.diff(bounds) < WORDS) & (np.diff(offsets) > 0)):
        own = letters[offsets[k]: offsets[k + 1]]
        found = tb.runs(own, min(WORDS, len(own)))
        rows.append(np.full(len(found), k))
        values.append(tb.mix(found + np.uint64(min(WORDS, len(own)))))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(rows, kind="stable")
    return values[order], np.searchsorted(rows[order], np.arange(len(offsets)))


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of PERMUTATIONS minima per text; rows of FULL for texts without shingles."""
    a, b = permutations()
    out = [np.zeros((0, PERMUTATIONS), np.uint32)]
    for part, body, offsets in tb.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", PIECE):
        values, bounds = shingles(body, offsets)
        own = np.full((len(part), PERMUTATIONS), FULL)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            first, hashed = bounds[some], np.empty_like(values)
            for k in range(PERMUTATIONS):
                np.multiply(values, a[k], out=hashed)
                np.add(hashed, b[k], out=hashed)
                own[some, k] = np.minimum.reduceat(hashed, first) >> np.uint64(32)
        out.append(own)
    return np.concatenate(out)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def written(signature: np.ndarray) -> pa.Array:
    return pa.array([base64.b64encode(s.tobytes()).decode() for s in signature.astype("<u4")], pa.string())


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in tb.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), written(signatures(part.column("text")))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """(range, ahead, doc_id, h, z): rows in order within their range, compressed, and last the row that follows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = rows.select("doc_id", "h").repartitionByRange(parts, "doc_id", "h").groupBy(F.spark_partition_id().alias("p"))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "h"))
    cuts = sorted((r[0], r[1] or 0, r[2]) for r in (row["k"] for row in dealt.agg(least.alias("k")).collect()))  # one per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for doc_id, h, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "h", "text"))):
                key = (doc_id is not None, doc_id or 0, h)
                own = bisect.bisect_right(cuts, key) - 1
                z = press.compress((text or "").encode())
                out.append((own, False, doc_id, h, z))
                if cuts[own] == key:
                    out.append(((own - 1) % len(cuts), True, doc_id, h, z))
            if out:
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["range", "ahead", "doc_id", "h", "z"])

    keyed = rows.mapInArrow(run, "range int, ahead boolean, doc_id long, h long, z binary")
    return keyed.repartitionByRange(parts, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), "h")


def edits(texts: list[str]) -> list[str]:
    """Each text but the last, its last half replaced by as many first code points of the next."""
    return [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_to_edits(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and its likeness to that and to the next document's."""

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        edited = edits(texts)
        own, other = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
             written(own[:-1]), written(other), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, held = None, [], [], 0
        for batch in tb.restored(batches):
            for range_, ahead, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("range", "ahead", "doc_id", "text"))):
                if range_ != now:
                    now, ids, texts, held = range_, [], [], 0
                elif texts and (ahead or held > GROUP):
                    yield made(ids, [*texts, text])
                    ids, texts, held = [], [], 0
                if not ahead:
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text)

    return in_ranges(docs).mapInArrow(run, EDITED)


def banded(docs: DataFrame) -> DataFrame:
    """Per row doc_id, h, size and two digests of its set, and a key per band of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in tb.slices(batch, "text"):
                row, token = shingle_sets(body, offsets, WORDS)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(tb.mix(token ^ s), dtype=np.uint64)]) for s in (tb.BASE, tb.BASE_INVERSE)]
                a, b = permutations()
                least = np.full((len(part), PERMUTATIONS), FULL)
                some = np.flatnonzero(np.diff(cuts))
                for k in range(PERMUTATIONS if len(some) else 0):
                    least[some, k] = np.minimum.reduceat(token.astype(np.uint64) * a[k] + b[k], cuts[some]) >> np.uint64(32)
                wide = PERMUTATIONS // BANDS
                keys = np.zeros((len(part), BANDS), np.uint64)
                for k in range(wide):
                    keys = tb.mix(keys * tb.BASE + least[:, k::wide])
                keys = tb.mix(keys + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(np.diff(cuts).astype(np.int32)), *[pa.array((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64)) for s in sums],
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "h", "n", "a", "b", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, h long, n int, a long, b long, keys array<long>")


def near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, component_id (least doc_id reachable by links of `threshold` percent) and n_links of its class, per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    profiles = settled(banded(rows))
    filled = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = settled(
        filled.groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("keys").alias("keys"))
        .select("n", "a", "b", F.col("a").alias("c"), "r.doc_id", "r.h", "keys"),
    )
    members = classes.select("c", "doc_id", "h", F.explode("keys").alias("key"))
    groups = members.groupBy("key").agg(F.min("c").alias("leader"), F.max("c").alias("last")).where("leader <> last").select("key", "leader")
    members = settled(members.join(groups, "key"))
    wanted = members.select("c", "doc_id", "h").distinct()
    texts = settled(tb.packed(rows, "doc_id", "h").join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("c", "z"))
    first = settled(compared(members.where("c <> leader").select(F.col("leader").alias("x"), F.col("c").alias("y")).distinct(), texts, WORDS, threshold))
    link = lambda df: df.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    parts = settled(components(texts.select(F.col("c").alias("id")), link(first))).withColumnRenamed("id", "c")
    placed = members.join(parts, "c").select("key", "c", "component")
    open_ = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    placed = settled(placed.join(open_, "key"))
    left, right = (placed.select("key", F.col("c").alias(s), F.col("component").alias(f"{s}_part")) for s in ("x", "y"))
    rest = left.join(right, "key").where("x_part < y_part").select("x", "y").distinct().join(first.select("x", "y"), ["x", "y"], "left_anti")
    links = settled(link(first).unionByName(link(compared(rest, texts, WORDS, threshold))).distinct())
    parts = components(texts.select(F.col("c").alias("id")), links).withColumnRenamed("id", "c")
    count = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    known = classes.drop("keys").join(parts, "c", "left").join(count, "c", "left").withColumn("piece", F.coalesce("component", "c"))
    least = known.groupBy("piece").agg(F.min("doc_id").alias("component_id"))
    known = settled(known.join(least, "piece").select("n", "a", "b", "component_id", "n_links"))
    released(members, first, placed, links, texts)
    return profiles.drop("keys", "h").join(known, ["n", "a", "b"], "left").select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
