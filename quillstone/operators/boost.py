"""Boosted trees as Spark ML grows them (log loss, variance gain, 32 bins, a first tree on the labels), on arrays.

Rows are blocks of bytes, a bin for each input, and are kept in memory as far as it goes; else they are read again. A pass
over them sums, for each node of a level, the smaller child's targets by input and bin; its sibling is the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.learn import NULLABLE
from quillstone.sources.tables import dropped, settled

BINS = 32
BLOCK = "y binary, bins binary"
SAMPLE = 40_000  # rows that a table's thresholds are taken from; Spark's trees take 10,000


def ready(x: np.ndarray, features: list[str]) -> np.ndarray:
    """Inputs by column: nan becomes -1, with an indicator for each that may be null, as learn.without_nulls() has them."""
    missing = np.isnan(x)
    return np.vstack([np.where(missing, -1.0, x), missing[[i for i, c in enumerate(features) if c in NULLABLE]]])


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return ready(np.array([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]), features)


def edges(sample: np.ndarray) -> list[np.ndarray]:
    """For each input at most 31 thresholds between the values of a sample: all of them, or evenly by count."""
    out = []
    for values in sample:
        v, n = np.unique(values, return_counts=True)
        middle = (v[:-1] + v[1:]) / 2
        if len(middle) >= BINS:
            at = np.searchsorted(np.cumsum(n), np.arange(1, BINS) * (len(values) / BINS))
            middle = middle[np.unique(np.minimum(at, len(middle) - 1))]
        out.append(middle)
    return out


def block(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """A row of BLOCK."""
    bins = np.array([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x, strict=True)], np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([y.astype(np.int8).tobytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary())], names=["y", "bins"])


@dataclass
class Tree:
    """Nodes as a heap. A node that is no split has the last bin for its threshold, and its value below it."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 1 << (self.depth + 1)
        self.feature, self.bin, self.value = np.zeros(n, np.int64), np.full(n, BINS, np.int64), np.zeros(n)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node, place = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for d in range(levels):
            used = range(1 << d, 2 << d)
            if d < 2:  # few nodes: by whole rows
                right = np.zeros(len(node), bool)
                for k in used:
                    right |= (node == k) & (bins[self.feature[k]] > self.bin[k])
            else:
                right = bins[self.feature[node], place] > self.bin[node]
            node = 2 * node + right
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def weight(self, k: int) -> float:
        return self.rate if k else 1.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x, strict=True)], np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, rounded to 6 digits."""
        bins, margin = self.binned(x), np.zeros(x.shape[1])
        for k, tree in enumerate(self.trees):
            margin += self.weight(k) * tree.scores(bins)
        return np.round(1 / (1 + np.exp(-2 * margin)), 6)


def _split(tree: Tree, node: int, held: np.ndarray, least: int) -> bool | None:
    """Sets a node's best split from its counts and sums by input and bin; says if the left child is the smaller. None
    without a split."""
    n, s = np.cumsum(held[0], axis=1), np.cumsum(held[1], axis=1)
    total, whole = n[0, -1], s[0, -1]
    left, right = n[:, :-1], total - n[:, :-1]
    ok = (left >= least) & (right >= least)
    if not ok.any():
        return None
    gain = np.where(ok, s[:, :-1] ** 2 / np.maximum(left, 1) + (whole - s[:, :-1]) ** 2 / np.maximum(right, 1) - whole**2 / total, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, b] <= 1e-9:
        return None
    tree.feature[node], tree.bin[node] = f, b
    tree.value[2 * node], tree.value[2 * node + 1] = s[f, b] / n[f, b], (whole - s[f, b]) / (total - n[f, b])
    return bool(n[f, b] <= total - n[f, b])


def fit(blocks: DataFrame, cuts: list[np.ndarray], rounds: int, depth: int, rate: float = 0.1, share: float = 0.8, least: int = 5, seed: int = 7) -> Boosted:
    """Trees over rows of BLOCK, which can be read again. Each tree takes `share` of the rows, drawn anew."""
    model, width = Boosted(cuts, rate), len(cuts)

    def begun(part: int, rows: Iterator) -> Iterator:
        for i, r in enumerate(rows):
            y = np.frombuffer(bytes(r.y), np.int8)
            yield (part, i), y, np.frombuffer(bytes(r.bins), np.uint8).reshape(width, len(y)), np.zeros(len(y), np.float32)

    def summed(rows, tree: Tree, k: int, level: int, small: np.ndarray):
        """Counts and sums of the targets for the nodes of a level that `small` numbers, over all rows."""
        size = int(small.max()) + 1

        def work(part: Iterator) -> Iterator:
            out = np.zeros((2, size, width, BINS))
            for at, y, bins, margin in part:
                use = np.random.default_rng((seed, k, *at)).random(len(y), np.float32) < share
                which = small[tree.nodes(bins, level)]
                taken = np.flatnonzero(use & (which >= 0))
                sign = 2.0 * y[taken] - 1
                target = sign if k == 0 else 4 * sign / (1 + np.exp(2 * sign * margin[taken]))
                first = which[taken] * BINS
                for f in range(width):
                    code = first + bins[f].take(taken)
                    out[0, :, f] += np.bincount(code, minlength=size * BINS).reshape(size, BINS)
                    out[1, :, f] += np.bincount(code, weights=target, minlength=size * BINS).reshape(size, BINS)
            yield out

        total = np.zeros((2, size, width, BINS))
        for part in rows.mapPartitions(work).collect():  # a table for each partition
            total += part
        return total

    rows = blocks.rdd.mapPartitionsWithIndex(begun).persist(StorageLevel.MEMORY_ONLY)
    for k in range(rounds):
        tree = Tree(depth)
        held = {1: summed(rows, tree, k, 0, np.array([-1, 0]))[:, 0]}
        tree.value[1] = held[1][1, 0].sum() / max(1.0, held[1][0, 0].sum())
        for level in range(depth):
            small, pairs = np.full(2 << (level + 1), -1), []
            for node in range(1 << level, 2 << level):
                left = _split(tree, node, held[node], least) if node in held else None
                if left is None:
                    tree.value[[2 * node, 2 * node + 1]] = tree.value[node]
                else:
                    small[2 * node + (0 if left else 1)] = len(pairs)
                    pairs.append((node, 2 * node + (0 if left else 1)))
            if not pairs or level + 1 == depth:
                held = {}
                continue
            total = summed(rows, tree, k, level + 1, small)
            held = {c: v for i, (node, child) in enumerate(pairs) for c, v in ((child, total[:, i]), (child ^ 1, held[node] - total[:, i]))}
        model.trees.append(tree)
        if k + 1 < rounds:
            weight = model.weight(k)
            old, rows = rows, rows.map(lambda r, tree=tree, weight=weight: (*r[:3], r[3] + (weight * tree.scores(r[2])).astype(np.float32))).persist(StorageLevel.MEMORY_ONLY)
            rows.foreachPartition(lambda part: [None for _ in part])
            old.unpersist()
    rows.unpersist()
    return model


def trained(rows: DataFrame, features: list[str], learning: Column, rounds: int = 20, depth: int = 5) -> Boosted:
    """On the rows of a stored table of pairs that the condition picks, with their label."""
    held = rows.filter(learning).select("s1_id", "cand_id", "label", *features)
    few = held.filter(F.pmod(F.xxhash64("s1_id", "cand_id"), F.lit(max(1, held.count() // SAMPLE))) == 0)
    width = len(ready(np.zeros((len(features), 1)), features))
    cuts = edges(np.hstack([np.zeros((width, 0)), *[matrix(b, features) for b in few.toArrow().to_batches()]]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield block(matrix(b, features), b.column("label").to_numpy(), cuts)

    blocks = settled(held.mapInArrow(binned, BLOCK), "bins", "zstd")
    model = fit(blocks, cuts, rounds, depth)
    dropped(blocks)
    return model


def scored(model: Boosted, rows: DataFrame, features: list[str]) -> DataFrame:
    """s1_id, cand_id, label, p."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(b.column, ("s1_id", "cand_id", "label")), pa.array(model.predict(matrix(b, features)))], names=["s1_id", "cand_id", "label", "p"])

    return rows.select("s1_id", "cand_id", "label", *features).mapInArrow(work, "s1_id string, cand_id string, label int, p double")
