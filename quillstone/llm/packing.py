"""Packing along a space-filling curve: similar documents share sequences.

Each document's hashed, normalised vector is projected to a few dimensions, quantised, and turned into its Hilbert key.
Documents are range-sorted by that key and their ids written one after another into sequences of a fixed length, cut
wherever a sequence is full. Only the last sequence of a range is short, so padding is below one sequence per range.

Null and empty texts are one end id (their vector is zero). Repeated rows are packed as often as they occur. Empty
tables give no pieces. A range is a bounded share of the rows, split by key, doc_id and row number, so equal keys spread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillstone.llm.arrays import chunks, mix
from quillstone.llm.shared import bytes_of, stored
from quillstone.llm.tokens import TOKENIZER_BYTES, piece_tokenizer


@dataclass(frozen=True)
class Packing:
    """bits: of each dimension on the curve; span: projected values beyond it count as it; buckets: hashed
    features; range_bytes: of stored ids in a range, so that their number follows the input."""

    tokenizer: str
    length: int = 1024
    dimensions: int = 4
    bits: int = 10
    span: float = 3.0
    buckets: int = 2048
    seed: int = 7
    range_bytes: int = 16 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n x d, each below 2**bits).

    The transform of J. Skilling, "Programming the Hilbert curve" (2004): undo the excess rotations of each level, then
    Gray-decode, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    level = np.uint64(1 << (bits - 1))
    while level > one:
        below = level - one
        for i in range(d):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            if i:
                x[i] ^= swap
        level >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = np.uint64(1 << (bits - 1))
    while level > one:
        flip ^= np.where((x[d - 1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def document_keys(ids: np.ndarray, counts: np.ndarray, p: Packing) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after another."""
    random = np.random.default_rng(p.seed)
    projection = random.standard_normal((p.buckets, p.dimensions)).astype(np.float32)
    hashed = (mix(ids.astype(np.uint64)) % np.uint64(p.buckets)).astype(np.int64)
    ends, out = np.cumsum(counts), []
    for at in range(0, len(counts), 512):
        part = counts[at : at + 512]
        end = int(ends[at + len(part) - 1])
        begin = end - int(part.sum())
        cell = np.repeat(np.arange(len(part)), part) * p.buckets + hashed[begin:end]
        tf = np.bincount(cell, minlength=len(part) * p.buckets).reshape(len(part), -1)
        vectors = np.log1p(tf.astype(np.float32))
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        projected = (vectors @ projection) / np.maximum(norm, 1e-9)[:, None]
        scaled = (np.clip(projected / p.span, -1, 1) + 1) / 2
        out.append(np.minimum(scaled * (1 << p.bits), (1 << p.bits) - 1).astype(np.int64))
    return hilbert_keys(np.concatenate(out), p.bits) if out else np.zeros(0, np.int64)


def encoded(docs: DataFrame, p: Packing) -> DataFrame:
    """doc_id, text -> doc_id, key, row, ids (little-endian, two bytes each while the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_tokenizer(p.tokenizer)
        part, row = TaskContext.get().partitionId() << 33, 0
        for rows in chunks(batches, "text", TOKENIZER_BYTES):
            ids, n = encoder.encode_ended(rows.column("text"))
            keys, raw, ends = document_keys(ids, n, p), memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
            if encoder.tokenizer.get_vocab_size() <= 1 << 16:
                raw, width = memoryview(ids.astype("<u2").tobytes()), 2
            else:
                width = 4
            blobs = [bytes(raw[width * (e - k) : width * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            numbers = np.arange(row, row + len(n), dtype=np.int64) + part
            row += len(n)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(keys), pa.array(numbers), pa.array(np.full(len(n), width, np.int32)), pa.array(blobs, pa.binary())], ["doc_id", "key", "row", "width", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, row long, width int, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, p: Packing, with_ids: bool = False) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, and, if asked for, its ids."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            pieces = []
            for doc_id, width, blob in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                raw, start = memoryview(ids.tobytes()), 0
                while start < len(ids):
                    n = min(len(ids) - start, p.length - filled)
                    piece = raw[4 * start : 4 * (start + n)]
                    pieces.append((doc_id, start, n, zlib.crc32(piece), len(ids), sequence, filled, *([bytes(piece)] if with_ids else ())))
                    start, filled = start + n, filled + n
                    if filled == p.length:
                        sequence, filled = sequence + 1, 0
            if pieces:
                types = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    # Written first: range bounds come from a sample of its small columns instead of a second encoding of all texts.
    rows = stored(encoded(docs, p), "encoded", compression="zstd")
    order, ranges = ("key", "doc_id", "row"), max(rows.sparkSession.sparkContext.defaultParallelism, -(-bytes_of(rows) // p.range_bytes))
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, schema)
