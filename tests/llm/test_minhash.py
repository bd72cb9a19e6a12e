import random

import numpy as np

from quillstone.llm.components import connected_components
from quillstone.llm.minhash import NearDuplicates, least_matches, near_duplicates
from quillstone.llm.queries import op9_minhash, oracle_sql
from tests.oracle import compare

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k=3):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=3, percent=85):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for x, (a, s) in enumerate(sets):
        for b, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = [None, "", "  \n", "one", "ONE", "one two", "One  two", "one two three", "É b c d", "é b c d", "a\x1cb c d", "a b c d", *near_copies(60, 1), *near_copies(40, 2), "x y z " * 30_000, "x y z " * 30_000 + "q"]
    rows = list(enumerate(texts + texts[3:6] + texts[12:20]))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, cluster long, bands string").repartition(5)
    for p in (NearDuplicates(), NearDuplicates(block=16)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, p).collect())
        assert got == brute(rows)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_repeated_ids_are_one_node(spark):
    a, b, c = near_copies(1, 7) + near_copies(1, 8) + near_copies(1, 9)
    rows = [(2, b), (3, a), (5, a), (5, b), (8, c), (8, ""), (9, None), (9, c + " z"), (11, "q r"), (11, "q r"), (12, "u v"), (12, "w x"), (13, "w x"), (14, ""), (14, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == brute(rows) and {(r[0], r[2]) for r in got} == {(2, 2), (3, 2), (5, 2), (8, 8), (9, 8), (11, 11), (12, 12), (13, 12), (14, 14)}


def test_null_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "e f g h"), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 2, 7, True), (None, 2, 7, True), (7, 2, 7, True), (None, 2, None, True), (None, 0, None, True)], key=str)


def test_five_words_at_four_fifths(spark):
    rows = list(enumerate(near_copies(80, 11) + near_copies(60, 12)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, NearDuplicates(words=5, percent=80, rows=5)).collect())
    assert got == brute(rows, 5, 80) and 2 < len({r[2] for r in got}) < 140


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5), (3, 2)]
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: root(a) for a in up if root(a) != a}


def test_pruning_keeps_pairs_at_the_threshold():
    p, rng = NearDuplicates(), np.random.default_rng(0)
    steps = np.arange(p.batch, p.hashes + 1, p.batch)
    seen = np.cumsum(rng.random((200_000, p.hashes)) < 0.85, axis=1)[:, steps - 1]
    assert (seen < least_matches(p)[steps - 1]).any(axis=1).mean() < 1e-4
    low = np.cumsum(rng.random((20_000, p.hashes)) < 0.6, axis=1)[:, steps - 1]
    assert (low < least_matches(p)[steps - 1]).any(axis=1).mean() > 0.999


def test_query_equals_sql(spark):
    assert compare(op9_minhash(spark, "/root/testdata/sf0.01"), oracle_sql()["op9_minhash"], "/root/testdata/sf0.01") == 1000
