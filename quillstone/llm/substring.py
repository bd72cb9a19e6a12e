"""Substring dedup with suffix automata: words in any window that occurs elsewhere are removed.

1. Each window of `window` words has a smallest k-gram hash, its anchor. Equal windows have equal anchors, so only
   windows whose anchor occurs twice or more in the corpus can repeat. Anchors are counted over all documents.
2. Successive windows with the same anchor form a segment. Segments meet by anchor: the distinct segments of an anchor
   are a shard of the reference, over which one generalised suffix automaton is built; every segment that is not itself
   repeated streams through it, and its matching statistics tell which of its windows occur twice or more.
3. The ranges found go back to their documents.

A shard's automaton is built in the task where the shard's segments arrive, rather than broadcast: the reference here
is the corpus itself, so the sum of the automata grows with it and no executor could hold it. For a bounded reference
text, remove_reference() does broadcast them. Anchors that occur more often than `hot` times are handled a window at a
time, counted by hash before the shuffle, so no shard grows beyond bounds.

Rows with a null doc_id are documents like others. Null and empty texts have no words. Texts shorter than a window keep all. Repeated rows remove each other's words, and
a window that overlaps its own repetition counts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, covered, inside, mix, rolling, sha256, word_hashes, words
from quillstone.llm.shared import release, stored

KEY = ("doc_id", "text_hash")


@dataclass(frozen=True)
class SubstringDedup:
    """window: words of a window. gram: words of an anchor. hot: occurrences of an anchor beyond which its windows are
    counted one by one."""

    window: int = 35
    gram: int = 8
    hot: int = 4096


class SuffixAutomaton:
    """Of several sequences; counts how often each substring occurs, each sequence weighted."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        """Split off the strings of q that end in p's longest string and the symbol."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, sequence: list, weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, symbol, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and (q := self.next[p].get(symbol)) is None:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q)
                last = new
            self.count[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Carry counts from longer to shorter strings; call once, after the last add()."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]
        return self

    def windows(self, sequence: list, n: int, least: int) -> list[bool]:
        """For each run of n symbols, whether it occurs `least` times or more: matching statistics, cut at n."""
        out, state, matched = [], 0, 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while self.length[max(self.link[state], 0)] >= n:
                state = self.link[state]
                matched = self.length[state]
            if i >= n - 1:
                out.append(matched >= n and self.count[state] >= least)
        return out


def sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over all runs of n values, by doubling."""
    size, width = len(a) - n + 1, 1
    if size <= 0:
        return a[:0]
    while 2 * width <= n:
        a = f(a[:-width], a[width:])
        width *= 2
    return f(a[:size], a[n - width : n - width + size])


class _Windows:
    """Words, hashes and anchors of a column of texts."""

    def __init__(self, column: pa.Array, p: SubstringDedup):
        self.p = p
        self.flat, self.offsets = words(column)
        self.hashes = word_hashes(self.flat, 23)
        self.n = len(self.hashes)
        self.grams = rolling(self.hashes, p.gram)
        self.reach = p.window - p.gram + 1
        self.anchor = sliding(self.grams, self.reach, np.minimum)
        self.valid = inside(self.offsets, p.window, self.n)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def occurrences(self) -> np.ndarray:
        """Positions of the grams that are the smallest of some window."""
        if not len(self.anchor):
            return np.zeros(0, np.int64)
        edge = np.zeros(self.reach - 1, np.uint64)
        most = sliding(np.concatenate([edge, np.where(self.valid, self.anchor, np.uint64(0)), edge]), self.reach, np.maximum)
        return np.flatnonzero(most == self.grams)

    def segments(self, common: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows with the same one of the given anchors (a window each for hot ones): key, two fingerprints,
        first window, number of windows."""
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(self.anchor):
            return empty
        is_hot = self.valid & np.isin(self.anchor, hot)
        wanted = self.valid & (np.isin(self.anchor, common) | is_hot)
        if not wanted.any():
            return empty
        before = np.zeros(len(wanted), bool)
        before[1:] = wanted[1:] & wanted[:-1] & (self.anchor[1:] == self.anchor[:-1]) & ~is_hot[1:]
        begin = np.flatnonzero(wanted & ~before)
        after = np.ones(len(wanted), bool)
        after[:-1] = ~before[1:]
        count = np.flatnonzero(wanted & after) + 1 - begin
        prints = []
        for base, seed in ((0x9E3779B97F4A7C15, 0x51ED27), (0xD1B54A32D192ED03, 0x7F4A1)):
            powers, inverse = (np.full(self.n + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            powers[0] = inverse[0] = 1
            powers, inverse = np.cumprod(powers), np.cumprod(inverse)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hashes ^ np.uint64(seed)) * powers[:-1], dtype=np.uint64)])
            prints.append(mix((total[begin + count + self.p.window - 1] - total[begin]) * inverse[begin] + count.astype(np.uint64)).view(np.int64))
        key = np.where(is_hot[begin], prints[0], self.anchor[begin].view(np.int64))
        return key, prints[0], prints[1], begin, count


def _with_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, with right's columns where it has a row of the same KEY; a null doc_id equals another."""
    named = right.withColumnsRenamed({c: f"{c}_of" for c in KEY})
    return left.join(named, (left["doc_id"].eqNullSafe(named["doc_id_of"])) & (left["text_hash"] == named["text_hash_of"]), "left").drop("doc_id_of", "text_hash_of")


def anchors(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """doc_id, text_hash, anchors (as often as they occur)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            w = _Windows(part.column("text"), p)
            at = w.occurrences()
            ends = np.searchsorted(at, w.offsets).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.grams[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), lists], [*KEY, "anchors"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, anchors array<long>")


def _joined(w: _Windows, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words of runs, as one string each."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), w.flat.take(pa.array(at)))
    return pc.binary_join(lists, " ")


def _blanked(column: pa.Array, blank: np.ndarray) -> pa.Array:
    """The column, null where `blank`."""
    return column.take(pa.array(np.arange(len(column)), mask=blank))


def _lists(column: pa.Array) -> np.ndarray:
    return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)


def split_off(docs: DataFrame, repeated: DataFrame, p: SubstringDedup) -> DataFrame:
    """Final rows of documents without a repeated anchor (text null), and the others with their text and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            flat, offsets = words(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            whole = pc.binary_join(lists, " ").to_pylist()
            done = pc.is_null(part.column("common"))
            sums = [sha256(t) if d else None for t, d in zip(whole, done.to_pylist(), strict=True)]
            text = _blanked(part.column("text"), done.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.string()), text, part.column("common"), part.column("hot")], [*KEY, "n_words", "kept_sha256", "text", "common", "hot"])

    return _with_row(docs, repeated).mapInArrow(run, "doc_id long, text_hash long, n_words long, kept_sha256 string, text string, common array<long>, hot array<long>")


def distinct_segments(rows: DataFrame, p: SubstringDedup) -> DataFrame:
    """Segments, once per chunk of texts, with their count; hot ones without words, as their fingerprint says it all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            w = _Windows(part.column("text"), p)
            hot = _lists(part.column("hot"))
            key, one, two, begin, count = w.segments(_lists(part.column("common")), hot)
            if not len(key):
                continue
            order = np.lexsort((two, one, key))
            key, one, two, begin, count = (x[order] for x in (key, one, two, begin, count))
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            at = np.flatnonzero(first)
            times = np.diff(np.concatenate([at, [len(key)]]))
            key, one, two, begin, count = (x[at] for x in (key, one, two, begin, count))
            is_hot = np.isin(w.anchor[begin], hot)
            text = _blanked(_joined(w, begin, np.where(is_hot, 0, count + p.window - 1)), is_hot)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(one), pa.array(two), pa.array(times, pa.int64()), text], ["key", "one", "two", "times", "words"])

    return rows.mapInArrow(run, "key long, one long, two long, times long, words string")


def shard_verdicts(segments: list[tuple], p: SubstringDedup) -> list[tuple]:
    """Of an anchor's segments (one, two, times, words): those with windows that occur twice, and which, as a string of
    0 and 1 (null: all)."""
    single = [s for s in segments if s[2] == 1]
    out = [(one, two, None) for one, two, times, _ in segments if times > 1]
    if single and single[0][3] is not None:
        automaton = SuffixAutomaton()
        split = [s[3].split(" ") for s in segments]
        for s, symbols in zip(segments, split, strict=True):
            automaton.add(symbols, s[2])
        automaton.finish()
        for s, symbols in zip(segments, split, strict=True):
            if s[2] == 1:
                found = automaton.windows(symbols, p.window, 2)
                if any(found):
                    out.append((s[0], s[1], None if all(found) else "".join("01"[x] for x in found)))
    return out


def verdicts(segments: DataFrame, p: SubstringDedup) -> DataFrame:
    """key, one, two, repeated. An anchor's rows are sorted together, so a worker holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard: list[tuple] = []
        now = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "one", "two", "repeated"])

        for rows in batches:
            for key, one, two, times, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if key != now:
                    out += [(now, *v) for v in shard_verdicts(shard, p)]
                    shard, now = [], key
                if shard and shard[-1][:2] == (one, two):
                    shard[-1] = (one, two, shard[-1][2] + times, shard[-1][3])
                else:
                    shard.append((one, two, times, text))
            if len(out) > 20_000:
                yield batch()
        out += [(now, *v) for v in shard_verdicts(shard, p)]
        if out:
            yield batch()

    return segments.repartition("key").sortWithinPartitions("key", "one", "two").mapInArrow(run, "key long, one long, two long, repeated string")


def instances(rows: DataFrame, p: SubstringDedup) -> DataFrame:
    """Every segment of every document: key, one, two, doc_id, text_hash, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            w = _Windows(part.column("text"), p)
            key, one, two, begin, count = w.segments(_lists(part.column("common")), _lists(part.column("hot")))
            doc = w.doc_of(begin)
            ids = [part.column(c).take(pa.array(doc)) for c in KEY]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(one), pa.array(two), *ids, pa.array(begin - w.offsets[doc], pa.int64()), pa.array(count, pa.int64())], ["key", "one", "two", *KEY, "first", "windows"])

    return rows.mapInArrow(run, "key long, one long, two long, doc_id long, text_hash long, first long, windows long")


def without(rows: DataFrame, p: SubstringDedup) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: text and found ranges -> what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            flat, offsets = words(part.column("text"))
            starts = []
            for d, found in enumerate(part.column("found").to_pylist()):
                for f in found or ():
                    at = offsets[d] + f["first"]
                    starts.append(at + (np.arange(f["windows"]) if f["repeated"] is None else np.flatnonzero(np.frombuffer(f["repeated"].encode(), np.uint8) == 49)))
            gone = covered(np.concatenate(starts), p.window, len(flat)) if starts else np.zeros(len(flat), bool)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(~gone)))
            sums = [sha256(t) for t in pc.binary_join(lists, " ").to_pylist()]
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, p: SubstringDedup | None = None) -> DataFrame:
    """doc_id, text -> a row per document: doc_id, n_words, n_removed, kept_sha256."""
    p = p or SubstringDedup()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = stored(anchors(docs, p), "anchors", compression="lz4")
    exploded = known.select(*KEY, F.explode("anchors").alias("anchor"))
    counted = exploded.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    own = exploded.distinct().join(counted, "anchor")
    repeated = own.groupBy(*KEY).agg(F.collect_list(F.when(F.col("n") <= p.hot, F.col("anchor"))).alias("common"), F.collect_list(F.when(F.col("n") > p.hot, F.col("anchor"))).alias("hot"))
    rows = stored(split_off(docs, repeated, p), "repeating", compression="zstd")
    release(known)
    rest = rows.filter("text IS NOT NULL")
    found = stored(verdicts(distinct_segments(rest.select("text", "common", "hot"), p), p), "verdicts")
    release()
    ranges = instances(rest.select(*KEY, "text", "common", "hot"), p).join(found, ["key", "one", "two"]).groupBy(*KEY).agg(F.collect_list(F.struct("first", "windows", "repeated")).alias("found"))
    cut = without(_with_row(rest.select(*KEY, "text"), ranges), p)
    return rows.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionAll(cut)


def remove_reference(docs: DataFrame, reference: list[str], n: int = 35, shard_words: int = 100_000) -> DataFrame:
    """Drop from each text the spans of n words or more that occur in bounded reference texts: doc_id, kept, n_removed.

    The reference is cut into shards (overlapping by n - 1 words) whose automata are broadcast one to a shard.
    """
    shards = []
    for text in reference:
        symbols = words(pa.array([text]))[0].to_pylist()
        for at in range(0, max(1, len(symbols) - n + 1), shard_words):
            automaton = SuffixAutomaton()
            automaton.add(symbols[at : at + shard_words + n - 1])
            shards.append(automaton.finish())
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                symbols = words(pa.array([text or ""]))[0].to_pylist()
                hit = {i for a in held.value for i, x in enumerate(a.windows(symbols, n, 1)) if x}
                gone = covered(np.array(sorted(hit), np.int64), n, len(symbols))
                rows.append((doc_id, " ".join(s for s, g in zip(symbols, gone, strict=True) if not g), int(gone.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["doc_id", "kept", "n_removed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kept string, n_removed long")
