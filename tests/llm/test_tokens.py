import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm.tokenfiles import read_tokens, with_checksums, write_tokens
from quillstone.llm.tokens import PieceTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, PLAIN = PieceTokenizer(PATH), Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\x1c\x85\xa0　ab,.'1é日<|>s"), st.text()), max_size=6))
def test_pieces_equal_whole_texts(values):
    flat, n = OURS.encode(pa.array(values, pa.string()))
    expected = [ids(v) for v in values]
    assert n.tolist() == [len(x) for x in expected]
    assert flat.tolist() == [i for x in expected for i in x]


def test_files(spark, tmp_path):
    rows = [(7, "b  c\n\n d <|endoftext|>", 1), (3, None, 2), (5, "", 3), (5, "same", 4), (5, "same", 5), (9, "long words " * 30_000, 6)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3), PATH, str(tmp_path / "t"))
    got = sorted(with_checksums(read_tokens(spark, str(tmp_path / "t"))).collect())
    expected, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        x = np.array(ids(text) + [0], "<u4")
        expected.append((doc_id, len(x), zlib.crc32(x.tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "e"))
    assert read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_query_and_page_indexes(spark):
    from quillstone.llm.queries import op10_token_files

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got, at = sorted(op10_token_files(spark, "/root/testdata/sf0.001").collect()), 0
    assert [r.doc_id for r in got] == sorted(docs)
    for r in got:
        x = np.array(ids(docs[r.doc_id]) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_layout(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_tokens(docs, PATH, str(tmp_path / "t"))
    file = next(iter((tmp_path / "t").glob("*.parquet")))
    column = pq.ParquetFile(file).metadata.row_group(0).column(4)
    assert column.has_column_index and column.has_offset_index and "RLE_DICTIONARY" in column.encodings
