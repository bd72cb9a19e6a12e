import zlib

import numpy as np
import pyarrow as pa

from quillstone.llm.queries import op3_toxicity
from quillstone.llm.toxicity import Network, Toxicity, Vocabulary, calibrated, cells, encoded, fit, score, sigmoid, windows

SMALL = Toxicity(window=5, stride=3, word_buckets=64, char_buckets=64, size=3, hidden=4)


def test_windows_cover_every_word():
    for n in range(0, 40):
        first, size, doc = windows(np.array([0, 7, 7 + n, 9 + n]), SMALL)
        for d, (s, e) in enumerate(((0, 7), (7, 7 + n), (7 + n, 9 + n))):
            own = [(f, f + k) for f, k, x in zip(first, size, doc, strict=True) if x == d]
            assert own and {i for a, b in own for i in range(a, b)} == set(range(s, e)) and all(s <= a and b <= e for a, b in own)


def test_gradient_is_that_of_the_loss():
    column = pa.array(["you bad old fool go", "what a day it is to be out and", "so", ""])
    distinct, codes, offsets = encoded(column)
    v = Vocabulary(distinct, SMALL)
    first, size, _ = windows(offsets, SMALL)
    cell = cells(codes, first, size, len(distinct), SMALL)
    y, weight = np.arange(len(cell)) % 2, np.linspace(0.5, 1, len(cell))
    net = Network.fresh(SMALL)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}

    def loss():
        x = net.inputs(v).astype(np.float64)
        z = net.logits(x, cell).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    g = net.gradient(v, net.inputs(v), np.ones(len(distinct) + 1), cell, y.astype(float), weight)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        direction = rng.standard_normal(w.shape)
        direction /= np.linalg.norm(direction)
        kept = w.copy()
        net.w[k] = kept + 3e-2 * direction
        up = loss()
        net.w[k] = kept - 3e-2 * direction
        down = loss()
        net.w[k] = kept
        assert abs((up - down) / 6e-2 - (g[k] * direction).sum()) < 2e-4, k


def test_logits_are_those_of_a_plain_forward_pass():
    """Window by window and step by step, both directions, then attention."""
    column = pa.array(["you bad old fool go home", "what a day", "", "so"])
    distinct, codes, offsets = encoded(column)
    v, net = Vocabulary(distinct, SMALL), Network.fresh(SMALL)
    net.odds = (np.sort(v.hashes)[:3], np.array([1.5, -2, 0.5], np.float32))
    first, size, _ = windows(offsets, SMALL)
    x, w, h = net.inputs(v), net.w, SMALL.hidden
    got = net.logits(x, cells(codes, first, size, len(distinct), SMALL))
    for z, (f, n) in zip(got, zip(first, size, strict=True), strict=True):
        states = {}
        for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                a, b = x[codes[f + t]] @ w[f"x{side}"] + w[f"c{side}"], s @ w[f"h{side}"]
                update, reset = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
                s = update * s + (1 - update) * np.tanh(a[2 * h :] + reset * b[2 * h :])
                states[side, t] = s
        hidden = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(n)]).reshape(n, 2 * h)
        e = np.exp(hidden @ w["attention"])
        pool = (e / e.sum()) @ hidden if n else np.zeros(2 * h)
        assert abs(float(pool @ w["out"] + w["bias"][0]) - float(z)) < 1e-5


def test_calibration_meets_the_prior():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 4000)
    logit = rng.standard_normal(4000) + 3 * label
    a, b = calibrated(logit, label, 0.1)
    weight = np.where(label == 1, 0.1 / label.sum(), 0.9 / (1 - label).sum())
    assert abs((weight * sigmoid(a * logit + b)).sum() - 0.1) < 0.01


def test_edges(spark):
    rows = [(1, "fine words here", 0), (2, None, 1), (3, "", 0), (4, "awful idiot " * 20_000, 1), (5, "x", None), (1, "fine words here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    labels = docs.select("doc_id", "toxic")
    p = Toxicity(epochs=1, least_steps=5)
    for model in (fit(docs, labels, p), fit(docs, labels.filter("toxic = 1"), p), fit(docs, labels.limit(0), p)):
        got = score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, fit(docs, labels.filter("toxic = 1"), p)).collect()} == {1.0}
    assert score(docs.limit(0), fit(docs, labels, p)).collect() == []
    assert fit(docs.limit(0), labels, p) == 0.4
    # The sample's bytes are bounded: without room for any text the score is the share of label 1.
    assert {r.score for r in score(docs, fit(docs, labels, Toxicity(sample_bytes=0))).collect()} == {0.4}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = op3_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    own = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    ones, zeros = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.75
    assert np.mean([s >= 0.7 for s in zeros]) < 0.05
