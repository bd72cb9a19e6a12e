import public_tokenizers

import corpus_pipeline
from quillstone.llm.queries import queries
from quillstone.llm.secrets import SecretScan, redacted
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute as components
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    """Every stage on what its predecessor kept, held against a plain version of the same decision."""
    from quillstone.llm.toxicity import Toxicity, fit, score

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            check(out.collect(), {i: r.text for i, r in before.items()})
            break
        assert out.columns == COLUMNS
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(rows) == len(after) and 0 < len(after)
        if name == "toxicity":
            scores = score(docs, fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), Toxicity()))
            assert set(after) == {r.doc_id for r in scores.collect() if r.score < 0.7}
        elif name == "near_duplicates":
            assert set(after) == {i for i, _, c, _ in components([(i, r.text) for i, r in before.items()], 5, 80) if i == c}
        elif name == "decontamination":
            assert set(after) == {i for i, _, hit, _ in contaminated([(i, r.text) for i, r in before.items()], items) if not hit}
        if name == "secrets":
            scan = SecretScan(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            assert {i: r.text for i, r in after.items()} == {i: redacted(r.text, scan) for i, r in before.items()}
            assert any(r.text != before[i].text for i, r in after.items()) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(tuple(r) == tuple(before[i]) for i, r in after.items())
        docs = spark.createDataFrame(rows, out.schema)


def test_run_and_edges(spark):
    assert queries()["pipeline"](spark, SF).count() > 0
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "token = abcdefghijkl0123", "en", "s", 24), (None, "x y z w", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id AS score", "text AS tokens")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, None}, name
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_one_row_of_a_group_stays(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(9, prose), (9, prose), (4, prose + " x"), (None, prose), (None, prose), (6, "a b c d e f"), (6, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(1 AS LONG) AS n_chars")
    out = corpus_pipeline.near_duplicate_removal(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [4, 6] and sum(r.doc_id is None for r in out) == 2
