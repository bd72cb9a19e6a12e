"""The wide pairs on arrays, and what is made of them."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillstone.operators import boost, learn, metrics, pairs, wide
from quillstone.operators.retrieval import Retrieval, candidates
from quillstone.plans import registry
from quillstone.sources import tables

SF = "/root/testdata/sf0.001"


def _every(names):
    """A function that executors need no test module for."""

    def every(ids, cands, row, cand, x, label):
        values = [pa.array(v, from_pandas=True) for v in x]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), cands.take(pa.array(cand)), *values, pa.array(label.astype(np.int32))], names=["s1_id", "cand_id", *names, "label"])

    return every


@pytest.mark.parametrize("p", [Retrieval(), Retrieval(max_df=50, top_k=10, k_name=3, k_address=3), Retrieval(max_df=600, top_k=5, k_name=2, k_address=9)])
def test_pairs_on_arrays_are_those_of_the_joins(spark, monkeypatch, p):
    monkeypatch.setattr(wide, "GROUP", 100)  # a country at a time
    monkeypatch.setattr(wide, "CHUNK", 7)
    c = registry.context(spark, SF)
    plain = metrics.labelled(pairs.rerank_similarities(candidates(c.s1, c.pool, p), c.s1, c.pool), c.truth)
    schema = "s1_id string, cand_id string, " + ", ".join(f"{k} double" for k in wide.INPUTS) + ", label int"
    parts = list(wide.Wide(c.s1, c.pool, c.truth, p).run(_every(wide.INPUTS), schema))
    assert len(parts) == 3
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "cand_id", *[F.coalesce(F.col(k).cast("double"), F.lit(-9.0)) for k in wide.INPUTS], "label").collect()))
    assert [r for part in parts for r in rows(part)] and sorted(r for part in parts for r in rows(part)) == rows(plain)


def test_no_table_holds_the_wide_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    c = registry.Context(spark, SF)
    n = c.reranked.count()
    most = max(spark.read.parquet(str(p)).count() for p in Path(tmp_path).iterdir() if any(p.glob("*.parquet")))
    every = candidates(c.s1, c.pool).count()
    assert most < every and n < every
    assert not list(Path(tmp_path).glob("wide-bins*"))  # gone when the model is trained


def test_boosted_trees_are_those_of_spark(spark):
    draw = np.random.default_rng(3)
    x = np.round(draw.random((4, 3000)) * [[20], [25], [2], [5]], 0)
    y = ((x[0] > 12) ^ (x[1] > 10) | (draw.random(3000) < 0.05)).astype(int)
    names = ["brank", "bscore", "is_s3", "label"]
    rows = spark.createDataFrame([(*map(float, v), int(k)) for *v, k in zip(*x[:3], y, strict=True)], "brank double, bscore double, is_s3 double, label int").coalesce(1)
    spark_model = GBTClassifier(featuresCol="f", labelCol="label", maxIter=4, maxDepth=3, minInstancesPerNode=5, seed=7).fit(ready := VectorAssembler(inputCols=names[:3], outputCol="f").transform(rows))
    want = np.array([r[0] for r in spark_model.transform(ready).select(F.round(vector_to_array("probability")[1], 6)).collect()])
    cuts = boost.edges(x[:3])
    blocks = [boost.block(x[:3, at : at + 700], y[at : at + 700], cuts) for at in range(0, 3000, 700)]
    held = spark.createDataFrame([(bytearray(b.column("y")[0].as_py()), bytearray(b.column("bins")[0].as_py())) for b in blocks], boost.BLOCK)
    got = boost.fit(held, cuts, 4, 3, share=1.1).predict(x[:3])
    assert np.abs(got - want).max() < 1e-4
    whole = [(x[0] > 9).astype(float)[None], x[0] > 9]
    held = spark.createDataFrame([(bytearray(b.column("y")[0].as_py()), bytearray(b.column("bins")[0].as_py())) for b in [boost.block(whole[0], whole[1], boost.edges(whole[0]))]], boost.BLOCK)
    assert np.allclose(boost.fit(held, boost.edges(whole[0]), 1, 2, share=1.1).predict(whole[0]), np.where(whole[1], 0.880797, 0.119203))


def test_missing_inputs_are_marked():
    x = np.array([[1.0, np.nan], [np.nan, 2.0]])
    assert boost.ready(x, ["brank_name", "r_hn_eq"]).tolist() == [[1, -1], [-1, 2], [0, 1]]
    assert learn.RERANK_FEATURES == wide.INPUTS


def test_features_join_once(spark):
    """The anchors' votes and similarities start from the stored pairs, not from the joins of the other features."""
    c = registry.context(spark, SF)
    plan = pairs.build_features(c.candidates, c.s1, c.pool)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 10  # 26 if each starts from the joined rows


def test_a_stored_table_is_learned_and_scored_in_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    n = F.col("id")
    rows = spark.range(4000).select(F.concat(F.lit("S1-"), n).alias("s1_id"), n.cast("string").alias("cand_id"), (n % 7).alias("brank"), F.when(n % 3 > 0, n % 5).alias("hn_vote"), ((n % 7 > 3) & (n % 3 == 0)).cast("int").alias("label"))
    features = ["brank", "hn_vote"]
    model = boost.trained(rows, features, F.col("cand_id").cast("long") % 10 != 0)
    out = boost.scored(model, rows, features)
    assert out.columns == ["s1_id", "cand_id", "label", "p"] and out.count() == 4000
    assert out.filter((F.col("p") > 0.5) != (F.col("label") == 1)).count() == 0
    assert not list(Path(tmp_path).glob("bins*"))
