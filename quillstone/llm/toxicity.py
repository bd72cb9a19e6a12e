"""Toxicity by a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A text is read in overlapping windows of words, all of them; its score is that of its worst window, calibrated. A word
enters as a hashed embedding of itself, the mean of hashed embeddings of its character trigrams, and its log odds among
the learning rows. Learning alternates between picking the worst window of each learning text and training on those.

The learning rows are a bounded sample of labelled rows, the first by hash: about `sample` of either label, and of those as
many whole texts as take `sample_bytes`; scoring covers every text to its end. Null and empty texts are one empty window and get its score. Labels that are null, or neither 0
nor 1, are left out; without labels of both kinds every score is the share of label 1 (0 without any). Repeated rows and
ties need no rule, as each row is scored alone. Empty tables give no rows. A worker holds one chunk of texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, lean, mix, string_hashes, texts, words


@dataclass(frozen=True)
class Toxicity:
    """window, stride: in words. sample: learning rows of either label at most about. sample_bytes: of their texts, at
    most. epochs: passes over them, or more until least_steps batches. dropout: share of a batch's distinct words whose embeddings are left out. shrink: documents' worth of the
    overall odds that are mixed into a word's."""

    window: int = 32
    stride: int = 16
    word_buckets: int = 1 << 14
    char_buckets: int = 1 << 12
    size: int = 8
    hidden: int = 8
    sample: int = 2500
    sample_bytes: int = 64 << 20
    epochs: int = 7
    least_steps: int = 150
    dropout: float = 0.5
    batch: int = 128
    rate: float = 0.01
    decay: float = 0.03
    least_df: int = 3
    shrink: float = 8.0
    seed: int = 17


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Buckets of the distinct words of a column: of each word, and of its character trigrams."""

    def __init__(self, distinct: pa.Array, p: Toxicity):
        values = distinct.to_pylist()
        self.hashes = string_hashes(distinct, 41)
        self.word = (self.hashes % np.uint64(p.word_buckets)).astype(np.int64)
        points = np.frombuffer("".join(f"\x02{v}\x03" for v in values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, values), np.int64, len(values)) + 2
        self.n_grams = size - 2
        owner = np.repeat(np.arange(len(size)), size)
        if len(points) < 3:
            self.gram = np.zeros(0, np.int64)
            return
        h = (points[:-2] * np.uint64(1_000_003) + points[1:-1]) * np.uint64(1_000_003) + points[2:]
        self.gram = (mix(h) % np.uint64(p.char_buckets)).astype(np.int64)[owner[:-2] == owner[2:]]

    def mean_of_grams(self, table: np.ndarray) -> np.ndarray:
        if not len(self.n_grams):
            return np.zeros((0, table.shape[1]), table.dtype)
        begin = np.cumsum(self.n_grams) - self.n_grams
        return np.add.reduceat(table[self.gram], begin, axis=0) / self.n_grams[:, None].astype(table.dtype)


def windows(offsets: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, and text of every window; together a text's windows cover all its words."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - p.window) // p.stride) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * p.stride, np.maximum(n[doc] - p.window, 0))
    return offsets[:-1][doc] + start, np.minimum(n[doc] - start, p.window), doc


def cells(codes: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int, p: Toxicity) -> np.ndarray:
    """Word codes of windows (n x window), `pad` beyond their ends."""
    at = first[:, None].astype(np.int32) + np.arange(p.window, dtype=np.int32)
    out = codes[np.minimum(at, max(len(codes) - 1, 0))] if len(codes) else np.full(at.shape, pad)
    return np.where(np.arange(p.window) < size[:, None], out, pad)


PARTS = ("z", "r", "n")


@dataclass
class Network:
    """Weights; odds: hashes of words (sorted) and their log odds; scale, shift: of the calibrated logit."""

    p: Toxicity
    w: dict[str, np.ndarray]
    odds: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, p: Toxicity) -> Network:
        random, d, h = np.random.default_rng(p.seed), 2 * p.size + 1, p.hidden
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        w = {"word": draw(p.word_buckets, p.size, scale=0.05), "char": draw(p.char_buckets, p.size, scale=0.05)}
        for side in "fb":
            w[f"x{side}"] = draw(d, 3 * h, scale=d**-0.5)
            w[f"h{side}"] = draw(h, 3 * h, scale=h**-0.5)
            w[f"c{side}"] = np.zeros(3 * h, np.float32)
        w["attention"] = draw(2 * h, scale=0.1)
        w["out"] = draw(2 * h, scale=(2 * h) ** -0.5)
        w["bias"] = np.zeros(1, np.float32)
        return cls(p, w)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """Input vectors of distinct words, with a last row of zeros for padding."""
        x = np.zeros((len(v.word) + 1, 2 * self.p.size + 1), np.float32)
        x[:-1, : self.p.size] = self.w["word"][v.word]
        x[:-1, self.p.size : -1] = v.mean_of_grams(self.w["char"])
        keys, values = self.odds
        if len(keys):
            at = np.minimum(np.searchsorted(keys, v.hashes), len(keys) - 1)
            x[:-1, -1] = np.where(keys[at] == v.hashes, values[at], 0)
        return x

    def run(self, projected: np.ndarray, cell: np.ndarray, mask: np.ndarray | None, side: str, keep: bool = False):
        """Hidden states (window x n x h) of one direction; with keep, also what the gradient needs."""
        h, u = self.p.hidden, self.w[f"h{side}"]
        steps = range(cell.shape[1]) if side == "f" else range(cell.shape[1] - 1, -1, -1)
        state = np.zeros((len(cell), h), np.float32)
        out, held = np.empty((cell.shape[1], len(cell), h), np.float32), []
        for t in steps:
            a, b = projected[cell[:, t]], state @ u
            gates = 1 / (1 + np.exp(-(a[:, : 2 * h] + b[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                after = np.where(mask[:, t, None], after, state)
            if keep:
                held.append((t, state, z, r, new, b[:, 2 * h :]))
            state = after
            out[t] = state
        return (out, held) if keep else out

    def pooled(self, hidden: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights (window x n) and pooled states."""
        e = hidden @ self.w["attention"]
        if mask is not None:
            e = np.where(mask.T, e, -30)
        e = np.exp(e - e.max(axis=0))
        if mask is not None:
            e = e * mask.T
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        return a, np.einsum("tn,tnh->nh", a, hidden)

    def logits(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Of windows, a block at a time; whole windows need no mask."""
        pad, out = len(x) - 1, np.empty(len(cell), np.float32)
        projected = {s: x @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb"}
        short = (cell == pad).any(axis=1)
        for which in (np.flatnonzero(~short), np.flatnonzero(short)):
            for at in range(0, len(which), 4096):
                rows = which[at : at + 4096]
                own = cell[rows]
                mask = own != pad if short[rows[0]] else None
                hidden = np.concatenate([self.run(projected[s], own, mask, s) for s in "fb"], axis=2)
                out[rows] = self.pooled(hidden, mask)[1] @ self.w["out"] + self.w["bias"]
        return out

    def gradient(self, v: Vocabulary, x: np.ndarray, keep: np.ndarray, cell: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy over windows; keep: a factor for each word's embeddings."""
        p, h, w, pad = self.p, self.p.hidden, self.w, len(x) - 1
        mask = cell != pad
        projected = {s: x @ w[f"x{s}"] + w[f"c{s}"] for s in "fb"}
        ran = {s: self.run(projected[s], cell, mask, s, keep=True) for s in "fb"}
        hidden = np.concatenate([ran[s][0] for s in "fb"], axis=2)
        a, pool = self.pooled(hidden, mask)
        d_logit = ((sigmoid(pool @ w["out"] + w["bias"]) - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": pool.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * w["out"]
        d_a = np.einsum("tnh,nh->tn", hidden, d_pool)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["attention"] = np.einsum("tn,tnh->h", d_e, hidden)
        d_hidden = a[:, :, None] * d_pool + d_e[:, :, None] * w["attention"]
        d_x = np.zeros_like(x)
        for i, s in enumerate("fb"):
            u, d_state = w[f"h{s}"], np.zeros((len(cell), h), np.float32)
            d_u, d_projected = np.zeros_like(u), np.zeros_like(projected[s])
            for t, before, z, r, new, b in reversed(ran[s][1]):
                d = d_state + d_hidden[t, :, i * h : (i + 1) * h]
                m = mask[:, t, None]
                live = np.where(m, d, 0)
                d_z = live * (before - new) * z * (1 - z)
                d_n = live * (1 - z) * (1 - new * new)
                d_r = d_n * b * r * (1 - r)
                d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += before.T @ d_b
                d_state = np.where(m, live * z + d_b @ u.T, d)
                np.add.at(d_projected, cell[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            d_projected[pad] = 0
            g[f"h{s}"], g[f"x{s}"], g[f"c{s}"] = d_u, x.T @ d_projected, d_projected.sum(axis=0)
            d_x += d_projected @ w[f"x{s}"].T
        d_x[:, :-1] *= keep[:, None]
        g["word"] = np.zeros_like(w["word"])
        np.add.at(g["word"], v.word, d_x[:-1, : p.size])
        g["char"] = np.zeros_like(w["char"])
        np.add.at(g["char"], v.gram, np.repeat(d_x[:-1, p.size : -1] / v.n_grams[:, None], v.n_grams, axis=0))
        return g


def encoded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the code (32 bits) of each word, and where each text's words begin."""
    flat, offsets = words(pc.utf8_lower(texts(column)))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), offsets


def log_odds(codes: np.ndarray, doc: np.ndarray, label: np.ndarray, n_words: int, p: Toxicity) -> np.ndarray:
    """Of each distinct word, by the documents that have it; 0 for those in fewer than p.least_df."""
    pair = np.unique(codes.astype(np.int64) * len(label) + doc)
    word, doc = np.divmod(pair, len(label))
    ones = np.bincount(word, weights=label[doc], minlength=n_words)
    both = np.bincount(word, minlength=n_words)
    prior = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    value = np.log((ones + p.shrink * prior) / (both - ones + p.shrink * (1 - prior))) - np.log(prior / (1 - prior))
    return np.where(both >= p.least_df, np.clip(value, -4, 4), 0).astype(np.float32)


def train(column: pa.Array, label: np.ndarray, p: Toxicity, prior: float) -> Network:
    """Fit to whole texts and their labels; prior: the share of label 1 among all labelled rows."""
    net, random = Network.fresh(p), np.random.default_rng(p.seed)
    distinct, codes, offsets = encoded(column)
    v = Vocabulary(distinct, p)
    first, size, doc = windows(offsets, p)
    cell = cells(codes, first, size, len(distinct), p)
    # A quarter of the texts is kept out of the log odds and the training, for calibration.
    apart = random.random(len(label)) < 0.25
    word_doc = np.repeat(np.arange(len(label)), np.diff(offsets))
    own = ~apart[word_doc]
    place = np.cumsum(~apart) - 1
    odds = log_odds(codes[own], place[word_doc[own]], label[~apart], len(distinct), p)
    order = np.argsort(v.hashes)
    net.odds = (v.hashes[order][odds[order] != 0], odds[order][odds[order] != 0])
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.w.items()}
    steps = 0
    begin = np.searchsorted(doc, np.arange(len(label)))
    a_pass = -(-int((~apart).sum() + (label[~apart] == 0).sum()) // p.batch)
    for epoch in range(max(p.epochs, -(-p.least_steps // max(1, a_pass)))):
        if epoch:
            logits = net.logits(net.inputs(v), cell)
            best = begin + np.array([logits[s:e].argmax() for s, e in zip(begin, [*begin[1:], len(doc)], strict=True)])
        else:  # the window with the largest log odds
            held = np.concatenate([odds, [0]])[cell].max(axis=1)
            best = begin + np.array([held[s:e].argmax() for s, e in zip(begin, [*begin[1:], len(doc)], strict=True)])
        other = begin + (random.random(len(label)) * np.diff([*begin, len(doc)])).astype(np.int64)
        # The worst window of every text, and one more at random of the texts that are not toxic.
        use = np.concatenate([best[~apart], other[~apart & (label == 0)]])
        random.shuffle(use)
        for at in range(0, len(use), p.batch):
            rows = use[at : at + p.batch]
            seen, local = np.unique(cell[rows], return_inverse=True)
            seen = seen[seen < len(distinct)]
            small = Vocabulary(distinct.take(pa.array(seen)), p)
            local = np.minimum(local.reshape(len(rows), -1), len(seen))
            y = label[doc[rows]].astype(np.float32)
            weight = np.where(y == 1, 1.0, 0.5)
            x = net.inputs(small)
            keep = ((random.random(len(x)) >= p.dropout) / (1 - p.dropout)).astype(np.float32)
            x[:, :-1] *= keep[:, None]
            g = net.gradient(small, x, keep, local, y, weight)
            steps += 1
            for k, x in net.w.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                decay = p.decay if k in ("word", "char") else 0
                x -= p.rate * (m / (1 - 0.9**steps) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8) + decay * x)
    worst = np.maximum.reduceat(net.logits(net.inputs(v), cell), begin)
    net.scale, net.shift = calibrated(worst[apart], label[apart], prior)
    return net


def calibrated(logit: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic regression, with the labels weighted to their share in the whole."""
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    weight = np.where(label == 1, prior / n1, (1 - prior) / n0)
    x, beta = np.stack([logit, np.ones_like(logit)], 1).astype(np.float64), np.array([1.0, np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))])
    pull = np.array([1e-3, 1e-5])

    def loss(b: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, x @ b) - label * (x @ b))).sum() + (pull * (b - [1.0, 0.0]) ** 2).sum() / 2)

    for _ in range(50):
        q = sigmoid(x @ beta)
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, x.T @ (weight * (label - q)) - pull * (beta - [1.0, 0.0]))
        for _ in range(30):
            if loss(beta + step) <= loss(beta):
                break
            step = step / 2
        beta = beta + step
    return float(max(beta[0], 0.05)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity) -> Network | float:
    """From documents (doc_id, text) and labels (doc_id, toxic); a constant score if there is one label or none."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(1 in sizes)
    share = F.when(F.col("toxic") == 1, min(1.0, p.sample / sizes[1])).otherwise(min(1.0, p.sample / sizes[0]))
    # Ids of a few bytes, four times the sample at most, are broadcast; the texts stay where they are.
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))).filter(F.col("draw") < share * 1_000_000)
    chosen = drawn.groupBy("doc_id", "draw").agg(F.max("toxic").alias("toxic")).orderBy("draw", "doc_id").limit(4 * p.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("draw", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    prior = sizes[1] / (sizes[0] + sizes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = [], p.sample_bytes
        for part in chunks(batches, "text"):
            ends = np.cumsum(pc.binary_length(part.column("text")).to_numpy())
            kept = int(np.searchsorted(ends, left, side="right"))
            held.append(part.slice(0, kept))
            left -= int(ends[kept - 1]) if kept else 0
            if kept < part.num_rows:
                break
        t = pa.Table.from_batches(held) if held else None
        if t is not None and t.num_rows:
            label = t["toxic"].to_numpy()
            model = train(t["text"].combine_chunks(), label, p, prior) if 0 < label.sum() < len(label) else prior
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # Trained in one executor task, not on the driver: the bounded sample is all that it holds. Without documents it is
    # the share of label 1.
    trained = rows.repartition(1).sortWithinPartitions("draw", "doc_id", "text").mapInArrow(lean(run), "model binary").first()
    return pickle.loads(trained[0]) if trained else prior


def text_scores(column: pa.Array, net: Network | float) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the number of its windows."""
    if isinstance(net, float):
        return np.full(len(column), net), np.ones(len(column), np.int64)
    distinct, codes, offsets = encoded(column)
    x = net.inputs(Vocabulary(distinct, net.p))
    first, size, doc = windows(offsets, net.p)
    logits = np.concatenate([np.zeros(0, np.float32), *(net.logits(x, cells(codes, first[at : at + 65536], size[at : at + 65536], len(distinct), net.p)) for at in range(0, len(first), 65536))])
    worst = np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(column)))).astype(np.float64)
    return sigmoid(net.scale * worst + net.shift), np.bincount(doc, minlength=len(column))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, text -> doc_id, score (0 to 1), n_windows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, text_scores(part.column("text"), held.value))], ["doc_id", "score", "n_windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, n_windows long")
