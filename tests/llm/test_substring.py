import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.queries import op2_substring_dedup, oracle_sql
from quillstone.llm.substring import SubstringDedup, SuffixAutomaton, remove_reference, remove_repeats
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in split for k in range(len(w) - n + 1))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.integers(1, 5))
def test_automaton_counts_windows(sequences, n):
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s, 2)
    automaton.finish()
    seen = Counter(tuple(s[k : k + n]) for s in sequences for k in range(len(s) - n + 1))
    for least in (1, 3):
        for s in [*sequences, list("abcabcab")]:
            assert automaton.windows(s, n, least) == [2 * seen[tuple(s[k : k + n])] >= least for k in range(len(s) - n + 1)]


def corpus(n, seed):
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.randrange(10**5)}" for _ in range(k)]
    passages = [new(rng.randrange(30, 80)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a " * 200), (4, "a b " * 30), (5, "\x1c".join(new(40)))]
    for i in range(10, 10 + n):
        w = new(rng.randrange(5, 60))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages)[rng.randrange(10) :] + new(rng.randrange(20))
        rows.append((i, "  ".join(w)))
    rows += [(i + 1000, t) for i, t in rows[6:10]] + [rows[-1]]
    return rows


def test_against_brute_force(spark):
    rows = corpus(120, 4)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, key long").repartition(5)
    for p in (SubstringDedup(), SubstringDedup(hot=3), SubstringDedup(hot=0)):
        assert sorted(tuple(r) for r in remove_repeats(docs, p).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute(rows, 35)
    small = SubstringDedup(window=12, gram=5)
    assert sorted(tuple(r) for r in remove_repeats(docs, small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute(rows, 12)
    assert remove_repeats(docs.limit(0)).collect() == []


def test_reference_shards(spark):
    rng = random.Random(9)
    reference = [f"r{rng.randrange(1000)}" for _ in range(300)]
    docs = spark.createDataFrame([(1, "x " + " ".join(reference[50:120]) + " y"), (2, " ".join(reference[:20])), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_removed) for r in remove_reference(docs, [" ".join(reference)], 35, shard_words=64).collect()}
    assert got == {1: ("x y", 70), 2: (" ".join(reference[:20]), 0), 3: ("", 0)}


def test_query_equals_sql(spark):
    assert compare(op2_substring_dedup(spark, "/root/testdata/sf0.01"), oracle_sql()["op2_substring_dedup"], "/root/testdata/sf0.01") == 1000


def test_null_ids_are_documents(spark):
    rng = random.Random(7)
    new = lambda k: " ".join(f"w{rng.randrange(10**5)}" for _ in range(k))
    passage, other = new(50), new(45)
    rows = [(None, f"{new(9)} {passage}"), (1, f"{passage} {new(9)}"), (None, other), (None, other), (None, new(60)), (None, None), (2, new(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for p in (SubstringDedup(), SubstringDedup(hot=0)):
        got = [tuple(r) for r in remove_repeats(docs, p).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        expected = sorted((-1 if i is None else i, *r) for i, *r in brute([(-1 if i is None else i, t) for i, t in rows], 35))
        assert sorted((-1 if i is None else i, *r) for i, *r in got) == expected
