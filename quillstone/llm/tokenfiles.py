"""Token ids in Parquet: a list column with dictionary-coded ids, small row groups and page indexes.

Layout of a table: rows in ascending doc_id order, over files in ascending order of `part`. Each row has doc_id, part,
start_in_part, n_tokens and ids. Spark's Parquet writer gives every page a column index and an offset index, so a range
of doc_id reads only its pages, and reading lengths touches no page of ids.

Null and empty texts are one end id. Rows of the same doc_id are neighbours, in the order in which they are read. An empty
table is an empty file set that reads back with no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks
from quillstone.llm.tokens import TOKENIZER_BYTES, piece_tokenizer

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


@dataclass(frozen=True)
class TokenFileFormat:
    """row_group_bytes: of a row group before compression; page_rows: rows of a page at most, the unit of a selective read."""

    row_group_bytes: int = 16 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 200
    dictionary_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_bytes),
            "parquet.enable.dictionary": "true",
            "parquet.writer.version": "v2",  # ids that outgrow the dictionary, and lengths, become delta-coded
            "compression": self.codec,
        }


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, layout: TokenFileFormat | None = None) -> None:
    """Encode whole texts (doc_id, text) and write them to `path`. One shuffle, of the texts, by ranges of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = piece_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for rows in chunks(batches, "text", TOKENIZER_BYTES):
            ids, n = encoder.encode_ended(rows.column("text"))
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            before += int(ends[-1])

    # The range bounds are drawn from doc_id and row numbers alone: texts are read once, and equal or null ids still spread.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, SCHEMA).write.options(**(layout or TokenFileFormat()).options()).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; columns that are not selected are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per file
    base, total = [], 0
    for part in sorted(sums):
        base.append((part, total))
        total += sums[part]
    bases = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """`ids` replaced by ids_crc32, over little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            raw = memoryview(flat.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
