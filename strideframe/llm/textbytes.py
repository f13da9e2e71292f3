"""Arrow text as byte arrays: word spans and word hashes of many documents at once.

Helpers for operators whose tasks read text with numpy. A slice holds about `SLICE` bytes, so a task's
memory follows the longest document and never the partition. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


LETTERS = _letters()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLDED = LETTERS[LOWER]
#: Words of op4: everything from 0x80 up, digits and lower-case letters (A-Z are lowered first).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words of op6: everything but blank and 0x09 to 0x0D.
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** j and its inverse for j < n, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[name] = np.cumprod(column, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows holding about `size` bytes of the text column."""
    texts = batch.column(column).fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield (
            batch.slice(first, last - first), body[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first],
        )
        first = last


def words(body: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one past the last) of the maximal runs of `table` bytes."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[body]
    fresh = np.ones(len(body), bool)
    fresh[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    fresh[edges] = True
    starts = np.flatnonzero(inside & fresh)
    stop = np.ones(len(body), bool)
    stop[:-1] = ~inside[1:]
    stop[edges[1:] - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of every span, equal for equal bytes (after the folding that `letters` makes)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(body))
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(letters[body] * up, dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` consecutive hashes (one per start that has room)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * BASE + hashes[k: k + n]
    return mix(out)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of every item, from each row's first item and one past the last."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def packed(docs, *names: str, held=None):
    """docs(text, *names) with the text compressed as `z`, for shuffles that carry whole texts; of each batch the rows that `held` leaves."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = held(batch) if held else batch
            z = pa.array([None if t is None else press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z, *[batch.column(n) for n in names]], ["z", *names])

    return docs.select("text", *names).mapInArrow(run, f"z binary, {kinds}")


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `text` again in place of `z`, a few hundred rows at a time."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            text = pa.array([None if z is None else press.decompress(z).decode() for z in batch.column("z").to_pylist()], pa.string())
            names = [n for n in batch.schema.names if n != "z"]
            yield pa.RecordBatch.from_arrays([text, *[batch.column(n) for n in names]], ["text", *names])
