"""Vectorised work on the UTF-8 bytes of Arrow string columns, used inside tasks.

A batch of texts is looked at as one byte array with document offsets, so that words, word hashes
and shingle hashes of many documents come out of a few numpy passes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word pattern, and A-Z, as byte values.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 19

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(fold_case: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z share those of a-z if case is folded."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
    if fold_case:
        out[65:91] = out[97:123]
    return out


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to ``n`` at least."""
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            step = np.full(size, np.uint64(b))
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the document offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, number) of slices whose texts have about ``limit`` bytes; a longer text has a slice of its own."""
    _, offsets = bytes_of(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end - start
        start = end


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of a column."""
    for start, n in by_bytes(batch.column(column), limit):
        yield batch.slice(start, n)


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running sums from which the hash of any substring follows."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[fold_case][data] * up[: len(data)], out=out[1:])
    return out


def hash_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each document (and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` lower-cased words.

    A text with fewer words has the whole sequence as its one shingle; one without words has none.
    """
    data, offsets = bytes_of(texts)
    starts, ends, first = words(data, offsets)
    h = hash_of(prefix_hash(data, True), starts, ends)
    coef = mix(np.arange(101, 101 + size, dtype=np.uint64))
    n = len(h) - size + 1
    if n > 0:
        shingle = np.zeros(n, np.uint64)
        for i in range(size):
            shingle += h[i : n + i] * coef[i]
        shingle = mix(shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingle[a : b - size + 1]))
        elif b > a:
            short = h[a:b] * mix(np.arange(201, 201 + b - a, dtype=np.uint64))
            out.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys stand together.

    A group is held whole, so the plan above must bound the size of a group.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        k = keys.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and k[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = k[a]
    if held:
        yield pa.Table.from_batches(held)
