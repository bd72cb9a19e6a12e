"""Near duplicates by MinHash bands with sequential Bayesian verification, and their connected components.

1. Documents with equal shingle sets collapse to the one with the smallest doc_id.
2. Each remaining document's signature is cut into bands; documents that share a band are candidates. A bucket gives
   one row per member, to its smallest doc_id; connected by those, members form a cluster that holds all its pairs.
3. A cluster is cut into blocks of bounded size and each pair of blocks is compared in one task: candidates that share
   a band have their signatures compared batch by batch, until the posterior probability that the similarity reaches
   the threshold falls below the chosen miss probability; survivors are decided on their full shingle sets. Only links
   that join two components of the task leave it, so a group of copies never becomes a row per pair.

A shingle is a run of `words` words (A-Z lower-cased); a text with fewer is one shingle; one without words, or null, is
linked with nothing. Rows that repeat a doc_id are one node of the graph, whatever their texts. A null doc_id links
nothing: its component is the smallest doc_id with its text, or null, and it is kept. Empty tables give no rows. Hot buckets meet in AQE-split sort-merge joins after map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, lean, mix, rolling, word_hashes, words
from quillstone.llm.components import connected_components
from quillstone.llm.shared import stored


@dataclass(frozen=True)
class NearDuplicates:
    """percent: least similarity of a link, in hundredths. rows x bands hashes: a pair at 0.85 shares no band with a
    probability of (1 - 0.85**7)**32 = 4e-6; at 0.8, five rows to a band make it (1 - 0.8**5)**32 = 3e-6. miss: probability at which a comparison is given up. batch: hashes of one
    step. block: documents of a cluster that one task compares with as many others."""

    words: int = 3
    percent: int = 85
    rows: int = 7
    bands: int = 32
    batch: int = 32
    miss: float = 1e-6
    block: int = 256

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


@lru_cache(maxsize=4)
def least_matches(p: NearDuplicates) -> np.ndarray:
    """For n = 1, 2, ... hashes compared, the fewest matches with which P(similarity >= threshold | matches) >= miss.

    The prior is uniform, so the posterior after m matches of n is Beta(m + 1, n - m + 1); its tail beyond t is the
    binomial probability of at most m successes in n + 1 trials at t.
    """
    t, out = p.percent / 100, []
    for n in range(1, p.hashes + 1):
        log = np.cumsum([0.0, *np.log((n + 1 - np.arange(n + 1)) / np.arange(1, n + 2))])
        k = np.arange(n + 2)
        tail = np.cumsum(np.exp(log + k * np.log(t) + (n + 1 - k) * np.log1p(-t)))
        out.append(int(np.argmax(tail >= p.miss)))
    return np.array(out)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and how many each has."""
    flat, offsets = words(column, lower=True)
    n = np.diff(offsets)
    hashed = word_hashes(flat, 11)
    runs = rolling(hashed, k)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(offsets[:-1], count) + within
    value = np.zeros(len(doc), np.uint64)
    long = n[doc] >= k
    value[long] = runs[at[long]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        whole = np.uint64(n[d])
        for h in hashed[offsets[d] : offsets[d + 1]]:
            whole = mix(np.array([whole * np.uint64(3) + h]))[0]
        value[np.searchsorted(doc, d)] = whole
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[first], np.bincount(doc[first], minlength=len(n))


def signatures(value: np.ndarray, count: np.ndarray, p: NearDuplicates) -> np.ndarray:
    """MinHashes (32 bits) of sets that lie one after another; each set has at least one element."""
    random = np.random.default_rng(20)
    factors = random.integers(0, 1 << 31, p.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = random.integers(0, 1 << 32, p.hashes, dtype=np.uint32)
    begin, out = np.cumsum(count) - count, np.empty((p.hashes, len(count)), np.uint32)
    if len(count):
        half = (value >> np.uint64(32)).astype(np.uint32)
        hashed = np.empty_like(half)
        for k in range(p.hashes):
            np.bitwise_xor(half, masks[k], out=hashed)
            np.multiply(hashed, factors[k], out=hashed)
            np.minimum.reduceat(hashed, begin, out=out[k])
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray, p: NearDuplicates) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    parts = signature.reshape(len(signature), p.bands, p.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(p.rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def fingerprints(value: np.ndarray, count: np.ndarray) -> list[bytes]:
    """128 bits per set: two independent sums over its elements, and its size."""
    doc = np.repeat(np.arange(len(count)), count)
    sums = []
    for seed in (0x1234567, 0x89ABCDEF):
        total = np.zeros(len(count), np.uint64)
        np.add.at(total, doc, mix(value ^ np.uint64(seed)))
        sums.append(total)
    return [bytes(x) for x in np.stack([*sums, count.astype(np.uint64)], 1)]


def sets(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """doc_id, n_shingles, fingerprint and bands (null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            value, count = shingles(part.column("text"), p.words)
            prints = [f if n else None for f, n in zip(fingerprints(value, count), count.tolist(), strict=True)]
            full = count > 0
            keys = band_keys(signatures(value, count[full], p), p)
            at = np.zeros(len(count) + 1, np.int32)
            np.cumsum(full * p.bands, out=at[1:])
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(prints, pa.binary()), lists], ["doc_id", "n_shingles", "fingerprint", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def clusters(first: DataFrame) -> DataFrame:
    """doc_id, bands of distinct documents -> node, cluster, for all that share a bucket with another."""
    rows = stored(first.select("doc_id", F.explode("bands").alias("bucket")), "bands")
    pivots = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).filter("n > 1")
    pairs = rows.join(pivots.select("bucket", "pivot"), "bucket").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(pairs)
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct()).select("node", F.col("component").alias("cluster"))


def blocked(docs: DataFrame, members: DataFrame, p: NearDuplicates) -> DataFrame:
    """cluster, i, j, block, doc_id, text: every document of a cluster, once for each pair of blocks that it is in."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(p.block)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Both sides are dealt by document at every size: the members grow with the corpus, so they are never broadcast.
    texts = docs.join(placed.hint("merge"), docs["doc_id"] == placed["node"])
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return texts.select("cluster", "block", "doc_id", "text", others).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "text")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        self.up[self.root(b)] = self.root(a)


def block_links(doc_id: list, block: np.ndarray, column: pa.Array, p: NearDuplicates) -> list[tuple]:
    """Links between documents of two blocks (or within one) that join two components of what is given."""
    value, count = shingles(column, p.words)
    if not count.all():  # of rows that repeat a doc_id, some may be without words
        full = np.flatnonzero(count > 0)
        doc_id, block, count = [doc_id[i] for i in full], block[full], count[full]
        if not len(full):
            return []
    signature = signatures(value, count, p)
    keys = band_keys(signature, p)
    begin = np.cumsum(count) - count
    own = [value[s : s + n] for s, n in zip(begin.tolist(), count.tolist(), strict=True)]
    forest, links, least = _Forest(len(doc_id)), [], least_matches(p)
    two = block.min() != block.max()
    right = np.flatnonzero(block == block.max()) if two else np.arange(len(block))
    for a in np.flatnonzero(block == block.min()).tolist() if two else range(len(block)):
        rest = right if two else right[a + 1 :]
        rest = rest[(keys[rest] == keys[a]).any(axis=1)]
        matched = np.zeros(len(rest), np.int64)
        for at in range(0, p.hashes, p.batch):
            if not len(rest):
                break
            matched += (signature[rest, at : at + p.batch] == signature[a, at : at + p.batch]).sum(axis=1)
            alive = matched >= least[min(at + p.batch, p.hashes) - 1]
            rest, matched = rest[alive], matched[alive]
        for b in rest[np.argsort(-matched, kind="stable")].tolist():
            if forest.root(a) == forest.root(b):
                continue
            shared = len(np.intersect1d(own[a], own[b], assume_unique=True))
            if 100 * shared >= p.percent * (len(own[a]) + len(own[b]) - shared):
                forest.join(a, b)
                links.append((doc_id[a], doc_id[b]))
    return links


def links_of(blocks: DataFrame, p: NearDuplicates) -> DataFrame:
    """Verified links a, b. Each pair of blocks is sorted together, so a worker holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            found = block_links(t["doc_id"].to_pylist(), t["block"].to_numpy(), t["text"].combine_chunks(), p)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[at]:
                    if held and now != keys[at]:
                        yield decided(held)
                        held = []
                    held, now, at = [*held, batch.slice(at, k - at)], keys[at], k
        if held:
            yield decided(held)

    order = ("cluster", "i", "j")
    return blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(run), "a long, b long")


def classes(known: DataFrame) -> DataFrame:
    """doc_id, n_shingles, first: of each row, the smallest doc_id with its shingle set; its own without words.

    Only sets that occur twice or more are joined, and as a table of their own, so that both sides are dealt afresh and
    AQE splits a set that very many rows share."""
    sizes = known.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    shared = stored(sizes.filter("n > 1").select("fingerprint", "least"), "classes")
    rows = known.select("doc_id", "n_shingles", "fingerprint").join(shared.hint("merge"), "fingerprint", "left")
    return stored(rows.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("first")), "members")


def near_duplicates(docs: DataFrame, p: NearDuplicates | None = None) -> DataFrame:
    """doc_id, text -> a row per document: doc_id, n_shingles, component_id, kept."""
    p = p or NearDuplicates()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stored(sets(docs, p), "sets", compression="lz4")
    members = classes(known)
    firsts = members.filter("doc_id = first").select("doc_id").distinct()
    near = stored(clusters(known.select("doc_id", "bands").join(firsts, "doc_id", "left_semi")), "clusters")
    links = links_of(blocked(docs, near, p), p)
    # Rows of one doc_id with different sets link the classes of those.
    several = members.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("z")).filter("a < z").select("doc_id", "a")
    same = members.join(several, "doc_id").filter("first <> a").select("a", F.col("first").alias("b"))
    joined = connected_components(stored(links.unionAll(same), "links")).select(F.col("node").alias("first"), "component")
    component = F.coalesce("component", "first")
    return members.join(joined, "first", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
