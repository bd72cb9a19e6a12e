"""Arrow and numpy building blocks that the text operators share: chunking, word splitting, hashing."""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def chunks(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about `limit` bytes; one longer text is a slice of its own.

    It bounds what a Python worker holds, whatever the number of rows in Spark's batches.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def trim() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError):  # it is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of mapInArrow() that trims when a task ends: its worker waits for others, and the JVM's own stages that
    follow would share the executor's memory with the most that a task took."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def texts(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(column.cast(pa.string()), "")


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without space, tab, LF, VT, FF, CR) and, for each text, where its words begin; lower: A-Z only."""
    column = texts(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets.astype(np.int64) - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if kept.all():
        return flat, offsets
    return flat.filter(full), np.concatenate([[0], np.cumsum(kept)])[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """string_hashes() of many words, each distinct word hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return string_hashes(coded.dictionary, seed)[coded.indices.to_numpy()]


def rolling(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of k successive values; runs over text ends are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = hashes[:n].copy(), np.uint64(base | 1)
    for j in range(1, k):
        out *= factor
        out += hashes[j : j + n]
    return mix(out)


def inside(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the n - k + 1 runs of k words, those within one text."""
    size = max(0, n - k + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return doc[:size] == doc[k - 1 : k - 1 + size] if size else np.zeros(0, bool)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of k that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def crc_group(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
