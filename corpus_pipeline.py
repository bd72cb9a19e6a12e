"""The training-data pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of documents. Null, empty and repeated rows are treated as each operator's module states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, lean
from quillstone.llm.decontam import decontaminate
from quillstone.llm.minhash import NearDuplicates, near_duplicates
from quillstone.llm.packing import Packing, pack
from quillstone.llm.queries import TOXIC_SCORE, vocabulary
from quillstone.llm.secrets import SecretScan, redacted
from quillstone.llm.shared import store, table
from quillstone.llm.toxicity import Toxicity, fit, text_scores


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the ids; the ids grow with the corpus, so both sides are dealt by doc_id."""
    return docs.join(ids.distinct().hint("merge"), "doc_id", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the others go. Scored where they lie, without a shuffle."""
    docs = _documents(docs)
    held = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels"), Toxicity()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield part.filter(pa.array(text_scores(part.column("text"), held.value)[0] < TOXIC_SCORE))

    return docs.mapInArrow(lean(run), docs.schema)


#: Five words and 0.8, as no contract says otherwise; five hashes to a band, so that a pair at 0.8 shares none of the 32
#: bands with a probability of (1 - 0.8**5)**32 = 3e-6.
NEAR = NearDuplicates(words=5, percent=80, rows=5)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near duplicates; of rows that repeat its doc_id,
    the one with the smallest text hash. Rows without a doc_id cannot be told apart by it and all stay."""
    docs = _documents(docs)
    gone = near_duplicates(docs, NEAR).filter("NOT kept").select("doc_id")
    rest = _without(docs.filter("doc_id IS NOT NULL"), gone)
    # The anti join has dealt the rows by doc_id and sorted them, so this adds no shuffle.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return rest.withColumn("rank", rank).filter("rank = 1").drop("rank").unionAll(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; the others go."""
    docs = _documents(docs)
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, n_chars by the new length."""
    docs, scan = _documents(docs), SecretScan(vocabulary("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            old, size = part.column("text").to_pylist(), part.column("n_chars").to_pylist()
            new = [None if t is None else redacted(t, scan) for t in old]
            n = [s if a == b else len(b) for a, b, s in zip(old, new, size, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(new, pa.string()), part.column("lang"), part.column("source"), pa.array(n, pa.int64())], part.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs, Packing(vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", packing),
]

#: Trained scores, tokens and a space-filling curve are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spark.read.parquet(store(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return docs
