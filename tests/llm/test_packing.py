import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillstone.llm.packing import Packing, encoded, hilbert_keys, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_curve_visits_every_cell_by_unit_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(pieces, docs):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 1024
    return sizes


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "word " * 5000, 3), (4, "same text", 4), (5, "same text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    check(pack(docs, Packing(PATH)).collect(), {r[0]: r[1] for r in rows})
    assert pack(docs.limit(0), Packing(PATH)).collect() == []
    twice = pack(docs.unionAll(docs), Packing(PATH)).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in pack(docs, Packing(PATH)).collect())


def test_query(spark):
    from quillstone.llm.queries import op4_packing

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes = check(op4_packing(spark, "/root/testdata/sf0.01").collect(), docs)
    assert sum(1024 - s for s in sizes) < 0.01 * sum(sizes)


def test_neighbours_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    order = [r.doc_id for r in sorted(encoded(docs, Packing(PATH)).select("doc_id", "key").collect(), key=lambda r: r.key)]
    same = np.mean([lang[a] == lang[b] for a, b in itertools.pairwise(order)])
    share = np.unique(list(lang.values()), return_counts=True)[1] / len(lang)
    assert same > (share**2).sum() + 0.3
