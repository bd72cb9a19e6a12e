from pyspark.sql import functions as F

from quillstone.operators.retrieval import Retrieval, candidates
from quillstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_keys_of_many_records_still_give_candidates(spark):
    """120 pool records share every key with the S1; the sizes of the fixture's SQL drop those keys."""
    row = lambda i: (i, "us", "", "acme", "main street", "akm")
    schema = "entity_id string, country_n string, postcode string, name_core string, addr string, name_skel string"
    s1 = spark.createDataFrame([row("S1-1")], schema)
    pool = spark.createDataFrame([row(f"S2-{i}") for i in range(120)] + [(f"S3-{i}", "us", "", f"other{i}", f"road{i}", f"thr{i}") for i in range(80)], schema)
    assert candidates(s1, pool).count() == 120
    assert candidates(s1, pool, Retrieval(max_df=50, top_k=10, k_name=3, k_address=3)).count() == 0


def test_models_take_the_wide_candidates(spark):
    found = registry.queries()
    wide, few = found["wide_block_recall"](spark, SF).first(), found["block_recall"](spark, SF).first()
    assert wide.n_true == few.n_true and wide.n_found >= few.n_found and wide.n_cands > few.n_cands
    kept = found["reranker_scores"](spark, SF)
    assert kept.agg(F.max("rr_rank")).first()[0] > 16
    assert kept.join(found["wide_candidates"](spark, SF), ["s1_id", "cand_id"], "left_anti").count() == 0
    assert found["matcher_scores"](spark, SF).count() == kept.count()


def test_the_reranker_keeps_no_texts(spark):
    """Its tables hold a row for each of millions of pairs: keys, scores and similarities only."""
    columns = registry.context(spark, SF).reranked.columns
    assert not [c for c in columns if c.startswith(("name_", "addr", "postcode"))]
