"""Language identification by the nearest of several centroids per language.

A text's vector holds the TF-IDF weights of hashed character n-grams of its words (with word ends), normalised. The
document frequencies are counted over all learning rows; the centroids of each language are clustered (spherical
k-means) from a bounded sample of them. A text gets the language of the centroid with the largest cosine; `rejected`
tells that even that one is further away than nearly all learning rows of its language are from theirs.

Null texts and texts without a letter are `und` with score 0. Learning rows with a null lang are left out. Without any
learning rows every text is `und`. Ties between centroids go to the alphabetically first language. Repeated rows and
long texts are counted whole; a worker holds one chunk of texts and a dense block of vectors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, mix, texts, words

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageId:
    """buckets: hashed features. centroids: per language. sample: learning rows per language, at most, the first by hash,
    that the centroids are clustered from. quantile: of the learning rows' cosines, below which a text is rejected."""

    buckets: int = 4096
    orders: tuple[int, ...] = (1, 2, 3)
    centroids: int = 4
    sample: int = 1000
    iterations: int = 12
    quantile: float = 0.005
    seed: int = 3


def features(distinct: pa.Array, p: LanguageId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the distinct words, and how many each word has."""
    values = distinct.to_pylist()
    joined = "".join(f" {v} " for v in values)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, values), np.int64, len(values)) + 2
    word = np.repeat(np.arange(len(size)), size)
    out, owner = [], []
    for n in p.orders:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + points[j : j + len(h)]
        ok = word[: len(h)] == word[n - 1 :]
        out.append((mix(h * np.uint64(8) + np.uint64(n)) % np.uint64(p.buckets)).astype(np.int32)[ok])
        owner.append(word[: len(h)][ok])
    bucket, owner = np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([np.zeros(0, np.int64), *owner])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(values))


def blocks(column: pa.Array, p: LanguageId, rows: int = 256) -> Iterator[np.ndarray]:
    """Dense n-gram counts of the texts, `rows` at a time."""
    flat, offsets = words(pc.utf8_lower(texts(column)))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    bucket, n = features(coded.dictionary, p)
    begin = np.cumsum(n) - n
    for at in range(0, len(offsets) - 1, rows):
        part = offsets[at : at + rows + 1]
        own = codes[part[0] : part[-1]]
        text = np.repeat(np.arange(len(part) - 1), np.diff(part))
        # Words that a text repeats are spread to n-grams once, with their number as weight.
        pair, times = np.unique(text * max(1, len(n)) + own, return_counts=True)
        text, own = np.divmod(pair, max(1, len(n)))
        each = n[own]
        where = np.repeat(begin[own] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        cell = np.repeat(text, each) * p.buckets + bucket[where]
        yield np.bincount(cell, weights=np.repeat(times, each), minlength=(len(part) - 1) * p.buckets).reshape(len(part) - 1, -1).astype(np.float32)


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]


def document_frequencies(rows: DataFrame, p: LanguageId) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each bucket occurs, and the number of texts. A task returns its sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(p.buckets, np.int64), 0
        for part in chunks(batches, "text"):
            n += part.num_rows
            for counts in blocks(part.column("text"), p):
                total += (counts > 0).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, p.buckets)), pa.array(np.concatenate([[n], total]))], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(p.buckets), 0
    for r in sums:
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return df, n


def clustered(vectors: np.ndarray, k: int, p: LanguageId) -> np.ndarray:
    """Spherical k-means; empty clusters are dropped."""
    random = np.random.default_rng(p.seed)
    centres = vectors[random.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(p.iterations):
        best = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[best == j].sum(axis=0) for j in range(len(centres)) if (best == j).any()])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centres.astype(np.float32)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    lang: list[str]
    least: np.ndarray


def fit(rows: DataFrame, p: LanguageId) -> Centroids | None:
    """Learn from rows of text and lang (nulls left out)."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    df, n = document_frequencies(rows, p)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            langs = part.column("lang")
            at = 0
            for counts in blocks(part.column("text"), p):
                v = normalised(counts, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([langs.slice(at, len(v)), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "vector"])
                at += len(v)

    # The first p.sample rows of each language by hash; the filter before leaves little more than those to be ranked.
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, p.sample / size))).otherwise(share)
    draw = F.xxhash64("doc_id", "lang", "text")
    drawn = rows.withColumn("draw", F.pmod(draw, F.lit(1_000_000))).filter(F.col("draw") < 2 * share * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", draw))
    chosen = drawn.withColumn("rank", rank).filter(F.col("rank") <= p.sample).select("lang", "text")
    held: dict[str, list[np.ndarray]] = {}
    for r in chosen.mapInArrow(run, "lang string, vector binary").toLocalIterator():
        held.setdefault(r.lang, []).append(np.frombuffer(r.vector, np.float16).astype(np.float32))
    centres, langs, least = [], [], []
    for lang in sorted(held):
        vectors = np.stack(held[lang])
        own = clustered(vectors, p.centroids, p)
        centres.append(own)
        langs += [lang] * len(own)
        least += [float(np.quantile((vectors @ own.T).max(axis=1), p.quantile))] * len(own)
    return Centroids(idf, np.concatenate(centres), langs, np.array(least)) if centres else None


def predict(docs: DataFrame, model: Centroids | None, p: LanguageId) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score (cosine, 0 to 1), rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in chunks(batches, "text"):
            letters = pc.match_substring_regex(texts(part.column("text")), r"\pL").to_numpy(zero_copy_only=False)
            best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
            at = 0
            for counts in blocks(part.column("text"), p) if m is not None else ():
                cosine = normalised(counts, m.idf) @ m.centres.T
                best[at : at + len(cosine)] = cosine.argmax(axis=1)
                score[at : at + len(cosine)] = cosine.max(axis=1)
                at += len(cosine)
            known = letters & (best >= 0)
            langs = [m.lang[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            far = ~known | (score < (m.least[best] if m is not None else 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
