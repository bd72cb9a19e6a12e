import random
import zlib

import numpy as np
import pyarrow as pa

from quillstone.llm.langid import LanguageId, blocks, features, fit, predict
from quillstone.llm.queries import op6_language_id


def test_counts_are_of_whole_texts():
    p, rng = LanguageId(buckets=64), random.Random(3)
    values = [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(n)) for n in (0, 1, 30, 300)] + [None]
    got = np.concatenate(list(blocks(pa.array(values), p, rows=2)))
    for row, text in zip(got, values, strict=True):
        expected = np.zeros(64)
        for w in (text or "").split():
            np.add.at(expected, features(pa.array([w]), p)[0], 1)
        assert (row == expected).all()


def test_edges(spark):
    rows = [(1, "hello world this is", "en"), (2, None, "en"), (3, "12 34 !!", None), (4, "", "de"), (5, "bonjour le monde", "fr"), (5, "bonjour le monde", "fr"), (6, "ц" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    p = LanguageId()
    got = sorted((r.doc_id, r.lang_pred, r.score > 0, r.rejected) for r in predict(docs.withColumn("score", docs.doc_id), fit(docs, p), p).collect())
    assert [(i, x) for i, x, _, _ in got if i != 6] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (5, "fr")]
    assert got[-1][3]
    assert {r.lang_pred for r in predict(docs, fit(docs.limit(0), p), p).collect()} == {"und"}
    assert predict(docs.limit(0), fit(docs, p), p).collect() == []


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in own]) > 0.97
