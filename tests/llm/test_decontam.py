import re

from quillstone.llm.decontam import Decontamination, decontaminate
from quillstone.llm.queries import op7_decontamination, oracle_sql
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        t, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            n = min(10, len(b))
            for i in range(len(b) - n + 1) if n else ():
                for j in range(len(t) - n + 1):
                    if t[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item_id))
        out.append((doc_id, len(t), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short ITEM"), (3, None), (4, "..."), (5, "one Two three four five six seven eight nine ten"), (5, "a a a a a a a a a a a"), (6, "Ünïcode wörd É")]
DOCS = [(1, "x ONE two, three. four five six seven eight nine ten eleven z"), (2, None), (3, ""), (4, "a " * 500), (4, "a " * 500), (5, "short item short-item SHORT item"), (6, "two three four five six seven eight nine ten one"), (7, "ünïcode wörd É ünïcode wörd é"), (8, "eleven one two three four five six seven eight nine ten eleven twelve one")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, term string, n long")
    items = spark.createDataFrame([(*r, "y") for r in ITEMS], "item_id long, text string, position string")
    for p in (Decontamination(), Decontamination(broadcast_rows=0)):
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, items, p).collect()]
        assert sorted(got, key=repr) == brute(DOCS, ITEMS)
    assert decontaminate(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in decontaminate(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "two one extra three"), (2, "one two far far far three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.near_items, r.n_near) for r in decontaminate(docs, items, Decontamination(window=3, slop=1)).collect()}
    assert got == {1: (0, ["1"], 1), 2: (0, [], 0)}


def test_item_without_an_id(spark):
    docs = spark.createDataFrame([(1, "one two three"), (None, "three one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (3, "one two three")], "item_id long, text string")
    rows = lambda kept: {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, kept).collect()}
    assert rows(items) == {1: (3, ["3"]), None: (0, [])} and rows(items.filter("item_id IS NULL"))[1] == (3, [])


def test_query_equals_sql(spark):
    assert compare(op7_decontamination(spark, "/root/testdata/sf0.01"), oracle_sql()["op7_decontamination"], "/root/testdata/sf0.01") == 1000
