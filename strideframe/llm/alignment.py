"""Alignment of two tokenizers over a corpus, with document counts of linked ids behind a minimal perfect hash.

1. Units. A lone space before a plain character starts a new word for both vocabularies: A's split pattern cuts
   there, and no piece of B has a space behind another character. What lies between such cuts is encoded and
   aligned once per worker and batch of words; a document is the sequence of its units.
2. Links. Byte offsets where a token of A or of B ends cut a text into pieces that lie in one token of each, so
   every overlapping pair of occurrences is one piece. Offsets where both end cut it into groups.
3. First pass. Tasks count, per pair of ids, the documents that hold it linked, and write rows of (block, keys,
   counts); the block is part of a hash of the key.
4. Minimal perfect hash. The distinct keys of a block go through levels of bit tables: a key alone in its place
   is settled, the others go on to the next table; the rank of its bit is the key's slot. Keys lie by slot beside
   the tables, so that a lookup verifies the key that it finds.
5. Counts are dense vectors by slot, summed as a tree: within tasks of (block, branch), then per block.
6. Second pass. Documents are aligned again and look their links up. Tables of up to `within` keys go to every
   task; beyond that, the documents' keys go to the blocks that hold them.

The number of distinct keys follows from the two vocabularies (byte ranges of both tokens must agree) and not from
the corpus; a block's table is a 256th of it.

Defined cases: texts that are null or empty, or that do not come back from the joined bytes of their tokens (such
as those with U+2581) have no tokens: zeros, and '' in place of a digest; they count in no pair. Rows that repeat
a doc_id, or are repeated, are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .phases import settled

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A lone space before a character that no reading of \s takes for white space.
CUT = re.compile(r"(?<! ) (?=[!-~À-˯Ͱ-ԯ一-鿿])")
BLOCKS, BRANCHES = 256, 8
WITHIN = 4_000_000
REMEMBERED, BUFFERED = 600_000, 1 << 21
#: Characters that every version of Unicode puts into the same class; units of these go to the faster encoder of A.
PLAIN = re.compile(r"[\t\n\r -~À-ɏ‐-‧‰-⁞]*\Z")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIZE = 4 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(others)}}


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of all items of the ranges (start, count), one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Units:
    """Encoded and aligned units; what is remembered is dropped when it grows over REMEMBERED units."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        names = sorted(self.a.get_vocab(with_added_tokens=False).items(), key=lambda e: e[1])
        known = [b""] * (names[-1][1] + 1)
        for name, k in names:
            known[k] = bytes(letters[c] for c in name if c in letters)
        self.bytes_a = flat(known)
        self.wide = self.b.vocab_size()
        # ids of A are in the order of its merges, so they serve as ranks
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={k: i for i, k in enumerate(known) if k}, special_tokens={})
        most = max(len(known), self.wide)
        self.names = [np.array([f"{k}{mark}" for k in range(most)], object) for mark in ",|;"]
        piece = self.b.id_to_piece
        self.bytes_b = flat([
            bytes([int(piece(k)[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else piece(k).replace("▁", " ").encode()
            for k in range(self.wide)
        ])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.right = np.zeros(0, bool)
        self.ends = np.zeros(1, np.int64)  # of each unit's links in `keys`
        self.keys = np.zeros(0, np.int64)
        self.texts: list[str] = []

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit of every place, first place of each text and one past the last)."""
        if len(self.place) > REMEMBERED:
            self.forget()
        cut = []
        for text in texts:
            parts = CUT.split(" " + text) if text else []
            if parts and not parts[0]:
                del parts[0]
            elif parts:
                parts[0] = parts[0][1:]
            cut.append(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in cut])]).astype(np.int64)
        every, place = list(chain.from_iterable(cut)), self.place
        fresh = [u for u in dict.fromkeys(every) if u not in place]
        if fresh:
            self.learn(fresh)
        return np.array(list(map(place.__getitem__, every)), np.int64), bounds

    def joined(self, ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each token) of a sequence of ids."""
        body, at = table
        size = at[ids + 1] - at[ids]
        return body[gathered(at[ids], size)], np.cumsum(size)

    def learn(self, units: list[str]) -> None:
        raw = [(" " + u).encode() for u in units]
        fast = self.fast.encode_ordinary
        one = [fast(" " + u) if PLAIN.match(u) else self.a.encode(" " + u, add_special_tokens=False).ids for u in units]
        two = self.b.encode(units, num_threads=1)
        counts = [np.array(list(map(len, side)), np.int64) for side in (one, two)]
        ids = [np.array(list(chain.from_iterable(side)), np.int64) for side in (one, two)]
        size = np.array(list(map(len, raw)), np.int64)
        want = np.frombuffer(b"".join(raw), np.uint8)
        right = np.ones(len(units), bool)
        ends = []
        for side, n, table in zip(ids, counts, (self.bytes_a, self.bytes_b)):
            got, end = self.joined(side, table)
            last = np.concatenate([[0], end])[np.cumsum(n)]
            if len(got) != len(want) or (np.diff(last, prepend=0) != size).any() or (got != want).any():
                for k in range(len(units)):  # rare: look at each unit
                    first = last[k - 1] if k else 0
                    right[k] &= got[first: last[k]].tobytes() == raw[k]
            ends.append(end)
        # ends of tokens of right units, counted from the start of all right units
        start = np.cumsum(np.where(right, size, 0)) - np.where(right, size, 0)
        owner = [np.repeat(np.arange(len(units)), n) for n in counts]
        held = [right[o] for o in owner]
        for k in (0, 1):
            first = np.concatenate([[0], ends[k]])[np.cumsum(counts[k]) - counts[k]]
            ends[k] = (ends[k] - first[owner[k]] + start[owner[k]])[held[k]]
        a, b = ids[0][held[0]], ids[1][held[1]]
        merged = np.sort(np.concatenate(ends), kind="stable")
        again = np.flatnonzero(merged[1:] == merged[:-1])
        cuts, both = np.delete(merged, again), merged[again]
        link_a, link_b = (np.searchsorted(e, cuts) for e in ends)
        keys = a[link_a] * self.wide + b[link_b]
        unit = owner[0][held[0]][link_a]
        links = np.bincount(unit, minlength=len(units))
        groups = np.bincount(owner[0][held[0]][np.searchsorted(ends[0], both)], minlength=len(units))
        first = len(self.right)
        self.texts += self.written(a, b, [np.searchsorted(both, e) for e in ends], groups)
        self.sums = np.concatenate([self.sums, np.column_stack([np.where(right, counts[0], 0), np.where(right, counts[1], 0), groups, links])])
        self.right = np.concatenate([self.right, right])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(links)])
        self.keys = np.concatenate([self.keys, keys])
        self.place.update(zip(units, range(first, first + len(units))))

    def written(self, a: np.ndarray, b: np.ndarray, group: list[np.ndarray], groups: np.ndarray) -> list[str]:
        """Each unit's groups as text, every group with a semicolon behind it."""
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in group]
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + np.searchsorted(group[1], group[0], "left")] = np.where(last[0], self.names[1][a], self.names[0][a])
        line[np.arange(len(b)) + np.searchsorted(group[0], group[1], "right")] = np.where(last[1], self.names[2][b], self.names[0][b])
        line = line.tolist()
        stop = np.cumsum(groups)
        cut = np.concatenate([[0], np.searchsorted(group[0], stop) + np.searchsorted(group[1], stop)]).tolist()
        return ["".join(line[x:y]) for x, y in zip(cut, cut[1:])]

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, links of each unit) of the units' links in order."""
        count = self.ends[units + 1] - self.ends[units]
        return self.keys[gathered(self.ends[units], count)], count


_units: dict[str, Units] = {}


@dataclass(frozen=True)
class Vocabularies:
    """The contents of both vocabulary files, sent to tasks that have no such folder."""

    a_json: str
    b_model: bytes

    @property
    def wide(self) -> int:
        return self.units().wide

    def units(self) -> Units:
        """This worker's units; the second pass finds what the first has learnt."""
        name = hashlib.sha256(self.a_json.encode() + self.b_model).hexdigest()
        if name not in _units:
            _units.clear()
            _units[name] = Units(self.a_json, self.b_model)
        return _units[name]


def vocabularies(folder: str = FOLDER) -> Vocabularies:
    return Vocabularies(Path(folder, A_FILE).read_text(), Path(folder, B_FILE).read_bytes())


def block_of(keys: np.ndarray) -> np.ndarray:
    return (tb.mix(keys.astype(np.uint64)) >> np.uint64(56)).astype(np.int32)


def by_block(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    block = block_of(keys)
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(BLOCKS + 1))
    for k in np.flatnonzero(np.diff(cut)):
        some = order[cut[k]: cut[k + 1]]
        yield int(k), keys[some], values[some]


def lists_of(rows: list[tuple[int, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(k) for _, k, _ in rows])]).astype(np.int32)
    columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64))) for i in (1, 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *columns], names)


def documents(part: pa.RecordBatch, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit of every place, bounds of each text's places, whether the text has tokens)."""
    places, bounds = units.of([t or "" for t in part.column("text").to_pylist()])
    wrong = np.concatenate([[0], np.cumsum(~units.right[places])])
    return places, bounds, (np.diff(bounds) > 0) & (np.diff(wrong[bounds]) == 0)


def per_document(units: Units, places: np.ndarray, bounds: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, links) for the distinct keys of every text that has tokens."""
    row = np.repeat(np.arange(len(held)), np.diff(bounds))
    some = held[row]
    keys, count = units.links(places[some])
    span = int(keys.max(initial=0)) + 1  # a slice has few rows, so row * span + key stays far under 2^63
    both = np.sort(np.repeat(row[some], count) * span + keys)
    fresh = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return both[fresh] // span, both[fresh] % span, np.diff(np.append(fresh, len(both)))


def partial_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(block, keys, counts): documents per key, as far as a task has seen them between two writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = vocabulary.value.units()
        keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            own, at = np.unique(every, return_inverse=True)
            return own, np.bincount(at, weight, len(own)).astype(np.int64)

        for batch in batches:
            for part, _, _ in tb.slices(batch, "text", SIZE):
                waiting.append(per_document(units, *documents(part, units))[1])
                held += len(waiting[-1])
                if held > BUFFERED:
                    (keys, counts), waiting, held = merged(), [], 0
                    if len(keys) > BUFFERED:
                        yield lists_of(list(by_block(keys, counts)), ["block", "keys", "counts"])
                        keys = counts = np.zeros(0, np.int64)
        keys, counts = merged()
        if len(keys):
            yield lists_of(list(by_block(keys, counts)), ["block", "keys", "counts"])

    return docs.select("text").mapInArrow(run, "block int, keys array<long>, counts array<long>")


# --- minimal perfect hash of a block's keys ------------------------------------------------------------------


@dataclass
class Hashed:
    """Bit tables of a block, level after level, and its keys by slot."""

    sizes: np.ndarray  # places of each level
    bits: np.ndarray  # all levels' places, one bit each
    keys: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> Hashed:
        sizes, tables, left = [], [], keys
        while len(left):
            size = 2 * len(left) + 1
            place = cls.place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            tables.append(alone)
            left = left[~alone[place]]
        flat_bits = np.concatenate(tables) if tables else np.zeros(0, bool)
        made = cls(np.array(sizes, np.int64), np.packbits(flat_bits), np.zeros(len(keys), np.int64))
        made.keys[made.slot(keys)] = keys
        return made

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tb.mix(keys.astype(np.uint64) ^ tb.mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.bits, count=int(self.sizes.sum())).astype(bool)
        return bits, np.cumsum(bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; a key that was not hashed gets any slot or -1."""
        bits, rank = self.opened()
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = first + self.place(keys[left], level, size)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left, first = left[~hit], first + size
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, and -1 for keys that the table does not hold."""
        slot = self.slot(keys)
        return np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1) if len(self.keys) else slot

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.bits.tobytes(), self.keys.tobytes()

    @classmethod
    def of(cls, sizes: bytes, bits: bytes, keys: bytes) -> Hashed:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint8), np.frombuffer(keys, np.int64))


TABLE = "block int, sizes binary, bits binary, keys_by_slot binary"


def runs_of_blocks(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches, sorted by block (and `extra`), cut where these change."""
    for batch in batches:
        names = ["block", *extra]
        values = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cut = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1 if len(batch) else []
        for x, y in zip([0, *cut], [*cut, len(batch)]):
            if y > x:
                yield tuple(int(v[x]) for v in values), batch.slice(x, y - x)


def hash_tables(partials: DataFrame) -> DataFrame:
    """One row per block: the minimal perfect hash of its distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(block: int, keys: list[np.ndarray]) -> pa.RecordBatch:
            row = [pa.array([block], pa.int32()), *[pa.array([x], pa.binary()) for x in Hashed.build(np.concatenate(keys)).packed()]]
            return pa.RecordBatch.from_arrays(row, ["block", "sizes", "bits", "keys_by_slot"])

        now, waiting = None, []
        for (block,), part in runs_of_blocks(batches):
            if now is not None and block != now:
                yield made(now, waiting)
                waiting = []
            now = block
            waiting.append(part.column("key").to_numpy())
        if waiting:
            yield made(now, waiting)

    keys = partials.select("block", F.explode("keys").alias("key")).distinct()
    return keys.repartition("block").sortWithinPartitions("block").mapInArrow(run, TABLE)


def summed_vectors(rows: DataFrame, keys: list[str], turned) -> DataFrame:
    """The sum of dense vectors per run of `keys`; `turned(part)` gives the vectors of rows of one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key, total):
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([total.tobytes()], pa.binary())], [*keys, "vector"])

        now, total = None, None
        for key, part in runs_of_blocks(batches, *keys[1:]):
            if key != now and now is not None:
                yield made(now, total)
                total = None
            now = key
            for vector in turned(part):
                total = vector if total is None else total + vector
        if now is not None:
            yield made(now, total)

    schema = ", ".join(f"{k} int" for k in keys) + ", vector binary"
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def counted(partials: DataFrame, tables: DataFrame) -> DataFrame:
    """`tables` with `vector`: documents per slot, summed first per (block, branch), then per block."""

    def dense(part: pa.RecordBatch) -> Iterator[np.ndarray]:
        found, total = None, None
        for k in range(len(part)):
            if found is None:
                found = Hashed.of(*[part.column(n)[k].as_py() for n in ("sizes", "bits", "keys_by_slot")])
                total = np.zeros(len(found.keys), np.int64)
            slot = found.verified(part.column("keys")[k].values.to_numpy())
            total[slot] += part.column("counts")[k].values.to_numpy()  # keys of a row are distinct
        yield total

    def whole(part: pa.RecordBatch) -> Iterator[np.ndarray]:
        for v in part.column("vector"):
            yield np.frombuffer(v.as_py(), np.int64)

    branch = (F.pmod(F.xxhash64("keys"), F.lit(BRANCHES))).cast("int")
    dealt = partials.withColumn("branch", branch)
    spread = tables.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
    first = summed_vectors(dealt.join(spread, ["block", "branch"]), ["block", "branch"], dense)
    return tables.join(summed_vectors(first.select("block", "vector"), ["block"], whole), "block")


def highest(table: DataFrame, wide: int) -> DataFrame:
    """(a, most): the highest count of each id of A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                keys = np.frombuffer(batch.column("keys_by_slot")[k].as_py(), np.int64)
                count = np.frombuffer(batch.column("vector")[k].as_py(), np.int64)
                a, at = np.unique(keys // wide, return_inverse=True)
                most = np.zeros(len(a), np.int64)
                np.maximum.at(most, at, count)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(most)], ["a", "most"])

    return table.select("keys_by_slot", "vector").mapInArrow(run, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))


# --- second pass ---------------------------------------------------------------------------------------------


OWN = ("n_a", "n_b", "n_groups", "n_links")
DIGEST = f"doc_id long, {', '.join(f'{n} long' for n in OWN)}, n_best long, count_sum long, groups_sha256 string"


def own_columns(part: pa.RecordBatch, units: Units, places: np.ndarray, bounds: np.ndarray, held: np.ndarray) -> tuple[list[pa.Array], pa.Array]:
    total = np.zeros((len(places) + 1, 4), np.int64)
    np.cumsum(units.sums[places], axis=0, out=total[1:])
    sums = np.where(held[:, None], total[bounds[1:]] - total[bounds[:-1]], 0)
    where, texts = places.tolist(), units.texts
    digests = [
        hashlib.sha256("".join([texts[u] for u in where[x:y]])[:-1].encode()).hexdigest() if ok else ""
        for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), held.tolist())
    ]
    return [pa.array(sums[:, k]) for k in range(4)], pa.array(digests)


def looked_up(docs: DataFrame, vocabulary, sent) -> DataFrame:
    """The second pass with every block's table at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = vocabulary.value.units()
        rows, most = sent.value
        tables = {b: (Hashed.of(*packed), np.frombuffer(v, np.int64)) for b, packed, v in rows}
        best = np.zeros(max(most, default=0) + 1, np.int64)
        best[list(most)] = list(most.values())
        for batch in batches:
            for part, _, _ in tb.slices(batch, "text", SIZE):
                places, bounds, held = documents(part, units)
                # a unit's links have the same counts wherever it stands
                some, at = np.unique(places[np.repeat(held, np.diff(bounds))], return_inverse=True)
                keys, links = units.links(some)
                own, back = np.unique(keys, return_inverse=True)
                count = np.zeros(len(own), np.int64)
                for block, asked, index in by_block(own, np.arange(len(own))):
                    table, vector = tables[block]
                    count[index] = vector[table.verified(asked)]
                at_best = count == best[own // units.wide] if len(own) else np.zeros(0, bool)
                sums = np.zeros((2, len(some)), np.int64)
                unit = np.repeat(np.arange(len(some)), links)
                np.add.at(sums[0], unit, at_best[back].astype(np.int64))
                np.add.at(sums[1], unit, count[back])
                running = np.zeros((2, len(at) + 1), np.int64)
                np.cumsum(sums[:, at], axis=1, out=running[:, 1:])
                cut = np.concatenate([[0], np.cumsum(np.where(held, np.diff(bounds), 0))])
                best_n, count_sum = (running[k][cut[1:]] - running[k][cut[:-1]] for k in (0, 1))
                plain, digest = own_columns(part, units, places, bounds, held)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *plain, pa.array(best_n), pa.array(count_sum), digest],
                    ["doc_id", *OWN, "n_best", "count_sum", "groups_sha256"],
                )

    return docs.mapInArrow(run, DIGEST)


def joined_lookup(docs: DataFrame, vocabulary, table: DataFrame, most: DataFrame, wide: int) -> DataFrame:
    """The second pass for tables over `within`: the documents' keys meet the counts at their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, task, n = vocabulary.value.units(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, _, _ in tb.slices(batch, "text", SIZE):
                places, bounds, held = documents(part, units)
                plain, digest = own_columns(part, units, places, bounds, held)
                row, keys, links = per_document(units, places, bounds, held)
                cut = np.searchsorted(row, np.arange(len(held) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int64))) for v in (keys, links)]
                ids = pa.array((np.int64(task) << np.int64(40)) + n + np.arange(len(part)))
                n += len(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *plain, digest, ids, *lists], ["doc_id", *OWN, "groups_sha256", "row", "keys", "links"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in OWN)}, groups_sha256 string, row long, keys array<long>, links array<long>"
    seen = settled(docs.mapInArrow(run, schema))  # written once: the numbers of rows hold from here on

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                keys = np.frombuffer(batch.column("keys_by_slot")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.frombuffer(batch.column("vector")[k].as_py(), np.int64)), pa.array(keys // wide)], ["key", "n", "a"],
                )

    counts = table.select("keys_by_slot", "vector").mapInArrow(opened, "key long, n long, a long").join(most, "a")
    counts = counts.select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    asked = seen.select("row", F.explode(F.arrays_zip("keys", "links")).alias("e")).select("row", F.col("e.keys").alias("key"), F.col("e.links").alias("links"))
    sums = asked.join(counts, "key").groupBy("row").agg(F.sum(F.col("best") * F.col("links")).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return seen.drop("keys", "links").join(sums, "row", "left").select(
        "doc_id", *OWN, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def aligned(docs: DataFrame, folder: str = FOLDER, within: int = WITHIN) -> DataFrame:
    """doc_id, tokens of both vocabularies, groups, links, their counts and a digest of the groups, per row."""
    spark = docs.sparkSession
    own = vocabularies(folder)
    vocabulary = spark.sparkContext.broadcast(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partials = settled(partial_counts(texts, vocabulary))
    tables = settled(hash_tables(partials))
    table = settled(counted(partials, tables))
    most = highest(table, own.wide)
    keys = table.agg(F.sum(F.octet_length("keys_by_slot") / 8)).first()[0] or 0
    if keys > within:
        return joined_lookup(texts, vocabulary, table, settled(most), own.wide)
    # at most `within` keys of some 17 bytes, and one number per id of A
    rows = [(r["block"], (bytes(r["sizes"]), bytes(r["bits"]), bytes(r["keys_by_slot"])), bytes(r["vector"])) for r in table.toLocalIterator()]
    sent = spark.sparkContext.broadcast((rows, {r["a"]: r["most"] for r in most.collect()}))
    return looked_up(texts, vocabulary, sent)
