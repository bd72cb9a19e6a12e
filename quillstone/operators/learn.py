"""Models over pair features with Spark ML: the matcher, the re-ranker, and the monotone stacker.

Trees reject missing values, so a null becomes -1 with an indicator beside it. The stacker's coefficients are bounded
below by zero, which makes its probability rise with each of its inputs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.similarity import logit
from quillstone.functions.text import scorer_text

NULLABLE = ["brank_name", "brank_addr", "bname_norm", "baddr_norm", "c_oov_frac", "anc_nc_mean", "anc_nc_max", "anc_ad_mean", "anc_ad_max", "hn_vote", "n_anc_hn"]


def without_nulls(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Features as doubles, null as -1, with an indicator for each that may be null."""
    marks = {f"{c}_null": F.col(c).isNull().cast("double") for c in features if c in NULLABLE}
    rows = rows.withColumns(marks).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return rows, [*features, *marks]


def train_matcher(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 20, depth: int = 5, weight: str | None = None, stop: str | None = None, kind: str = "trees", rate: float = 0.1) -> PipelineModel:
    """kind: trees (boosted), forest or linear. stop: a boolean column that marks rows kept from training, at whose least
    loss the rounds of boosted trees end. weight: a column of row weights."""
    rows, inputs = without_nulls(rows, features)
    if kind == "forest":
        model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=rounds, maxDepth=depth, minInstancesPerNode=5, seed=7)
    elif kind == "linear":
        model = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.001, maxIter=50)
    else:
        model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, minInstancesPerNode=5, seed=7)
        if stop:
            model = model.setValidationIndicatorCol(stop)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), model]).fit(rows)


def save_model(model: PipelineModel, path: str, **about: object) -> None:
    """The model, and beside it a row of what it was trained on, both as tables that any executor reads."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    about = SparkSession.getActiveSession().read.parquet(f"{path}/about").first()[0]
    return PipelineModel.load(f"{path}/model"), json.loads(about)


def fold_of(block: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, features: list[str], train: Callable[[DataFrame], PipelineModel], block: str = "block", folds: int = 5, column: str = "p") -> tuple[DataFrame, list[PipelineModel]]:
    """Each row's score by the model of the folds that its block is not in, and the models. Whole blocks share a fold."""
    held = rows.withColumn("_fold", fold_of(F.col(block), folds))
    models, parts = [], []
    for k in range(folds):
        models.append(train(held.filter(F.col("_fold") != k)))
        parts.append(predict(models[-1], held.filter(F.col("_fold") == k), features, column))
    return reduce(DataFrame.unionByName, parts).drop("_fold"), models


def mean_of_models(models: list[PipelineModel], rows: DataFrame, features: list[str], column: str = "p") -> DataFrame:
    """New rows scored by the mean of the folds' models."""
    for k, model in enumerate(models):
        rows = predict(model, rows, features, f"_m{k}")
    mean = sum((F.col(f"_m{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return rows.withColumn(column, F.round(mean, 6)).drop(*[f"_m{k}" for k in range(len(models))])


# Inputs of the second stage.
STAGE2_FEATURES = "p r_s1 p_max p_sum n_hi n_s1 p_ratio gap_next c_n c_rank c_other c_n_hi p_ref ref_nc_ratio ref_nc_tset ref_ad_tset ref_nf_tsort".split()


def train_stage2(rows: DataFrame, rounds: int = 10, seed: int = 42) -> PipelineModel:
    """Rows with block and label. About a tenth of the blocks, by hash, stop the rounds."""
    stop = F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(10)) == 0
    return train_matcher(rows.withColumn("_stop", stop), STAGE2_FEATURES, rounds=rounds, depth=4, stop="_stop")


def rescored(rows: DataFrame, folds: int = 5) -> tuple[DataFrame, list[PipelineModel]]:
    """The second stage: rows of STAGE2_FEATURES, block and label with p2, out of fold by block. Spark's trees cannot
    be bound to rise with p or fall with the competitors' scores, as the original's are."""
    return out_of_fold(rows, STAGE2_FEATURES, train_stage2, folds=folds, column="p2")


def second_scores(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], column: str = "ce") -> DataFrame:
    """Pairs with texts t1 and t2 -> s1_id, cand_id, and what a scorer says of the texts, a batch at a time. The scorer is any
    function of two lists of texts, sent to the executors as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scorer(b.column("t1").to_pylist(), b.column("t2").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("s1_id"), b.column("cand_id"), pa.array(found, pa.float64())], ["s1_id", "cand_id", column])

    return pairs.select("s1_id", "cand_id", "t1", "t2").mapInArrow(run, f"s1_id string, cand_id string, {column} double")


def band_texts(scored: DataFrame, s1: DataFrame, pool: DataFrame, low: float = 0.02, high: float = 0.995) -> DataFrame:
    """Pairs in the band with the texts that a second scorer reads."""
    side = lambda df, key, name: df.select(F.col("entity_id").alias(key), scorer_text().alias(name))
    return scored.filter((F.col("p") >= low) & (F.col("p") < high)).join(side(s1, "s1_id", "t1"), "s1_id").join(side(pool, "cand_id", "t2"), "cand_id")


def restacked(scored: DataFrame, second: DataFrame, blocks: DataFrame, folds: int = 5) -> DataFrame:
    """scored with p replaced, in the band, by the stacker's value of p and a second score `ce` (0 to 1), out of fold by
    block."""
    band = scored.join(second, ["s1_id", "cand_id"]).join(blocks.select(F.col("entity_id").alias("s1_id"), "block"), "s1_id").withColumn("_fold", fold_of(F.col("block"), folds))
    parts = [stacked(train_stacker(band.filter(F.col("_fold") != k), ["p", "ce"]), band.filter(F.col("_fold") == k), ["p", "ce"], "p2") for k in range(folds)]
    found = reduce(DataFrame.unionByName, parts).select("s1_id", "cand_id", "p2")
    joined = scored.join(found, ["s1_id", "cand_id"], "left")
    return joined.withColumn("p", F.coalesce("p2", "p")).drop("p2")


def feature_ablation(rows: DataFrame, groups: dict[str, list[str]], score: Callable[[DataFrame], float], learning: Column, kind: str = "linear") -> dict[str, float]:
    """For each group of features, a score of the rows that are not for learning, by a model without the group; and of all."""
    every = [c for names in groups.values() for c in names]
    out = {}
    for left_out, names in {"": [], **groups}.items():
        features = [c for c in every if c not in names]
        model = train_matcher(rows.filter(learning), features, kind=kind)
        out[left_out or "all"] = score(predict(model, rows.filter(~learning), features))
    return out


def leave_one_out(rows: DataFrame, column: str, features: list[str], score: Callable[[DataFrame], float], kind: str = "linear") -> dict[str, float]:
    """For each value of a column, such as the country, a score of its rows by a model of all others."""
    values = sorted(r[0] for r in rows.select(column).distinct().collect())  # one row per country
    return {v: score(predict(train_matcher(rows.filter(F.col(column) != v), features, kind=kind), rows.filter(F.col(column) == v), features)) for v in values}


def predict(model: PipelineModel, rows: DataFrame, features: list[str], column: str = "p") -> DataFrame:
    """Rows with the model's probability; the model's own columns are dropped."""
    ready, inputs = without_nulls(rows, features)
    out = model.transform(ready).withColumn(column, F.round(vector_to_array("probability")[1], 6))
    return out.drop("features", "rawPrediction", "probability", "prediction", *[c for c in inputs if c not in features])


# Inputs of the re-ranker.
RERANK_FEATURES = "bscore bscore_norm brank bname baddr bname_norm baddr_norm brank_name brank_addr r_cc_ratio r_nf_part r_ad_tset r_nc_tset r_hn_eq".split()


def train_reranker(rows: DataFrame, rounds: int = 15, depth: int = 4) -> PipelineModel:
    return train_matcher(rows, RERANK_FEATURES, rounds=rounds, depth=depth)


def reranker_sample(parts: DataFrame, s1: DataFrame, per_country: int = 5000, seed: int = 42) -> DataFrame:
    """S1 records in neither the training nor the validation part: the first per_country of each country by hash."""
    rest = s1.join(parts.filter("part = 'rest'").select("entity_id"), "entity_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("country_n").orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id"))
    return rest.withColumn("_r", rank).filter(F.col("_r") <= per_country).drop("_r")


def reranker_recall(kept: DataFrame, wide: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs of the wide candidates' S1, and the shares of them among the wide and the kept candidates; kept
    candidates per S1. Both have s1_id and label."""
    people = wide.select("s1_id").distinct()
    n = truth.filter("match_id IS NOT NULL").join(people, "s1_id", "left_semi").agg(F.count("*").alias("n_true"))
    found = wide.agg(F.sum("label").alias("w")).join(kept.agg(F.sum("label").alias("k"), F.count("*").alias("rows")), F.lit(True)).join(people.agg(F.count("*").alias("s1")), F.lit(True))
    share = lambda c: F.round(F.col(c) / F.greatest("n_true", F.lit(1)), 6)
    return n.join(found, F.lit(True)).select("n_true", share("w").alias("wide_recall"), share("k").alias("kept_recall"), F.round(F.col("rows") / F.col("s1"), 6).alias("per_s1"))


def train_stacker(rows: DataFrame, scores: list[str], label: str = "label") -> PipelineModel:
    """On the logits of several models' probabilities."""
    inputs = [f"_{c}" for c in scores]
    lr = LogisticRegression(featuresCol="features", labelCol=label, lowerBoundsOnCoefficients=Matrices.dense(1, len(scores), [0.0] * len(scores)), maxIter=50)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), lr]).fit(_logits(rows, scores))


def _logits(rows: DataFrame, scores: list[str]) -> DataFrame:
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumns({f"_{c}": logit(bounded(c)) for c in scores})


def stacked(model: PipelineModel, rows: DataFrame, scores: list[str], column: str = "p") -> DataFrame:
    out = model.transform(_logits(rows, scores)).withColumn(column, F.round(vector_to_array("probability")[1], 6))
    return out.drop("features", "rawPrediction", "probability", "prediction", *[f"_{c}" for c in scores])


def pseudo_labels(scored: DataFrame, high: float = 0.97, low: float = 0.03, negatives: float = 2.0, weight: float = 0.5) -> DataFrame:
    """Sure pairs as labels with a weight; negatives are thinned by hash to about `negatives` per positive."""
    sure = scored.filter((F.col("p") >= high) | (F.col("p") <= low)).withColumn("label", (F.col("p") >= high).cast("int"))
    sizes = {r.label: r.n for r in sure.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, negatives * sizes.get(1, 0) / max(1, sizes.get(0, 1)))
    keep = (F.col("label") == 1) | (F.pmod(F.xxhash64("s1_id", "cand_id"), F.lit(1_000_000)) < share * 1_000_000)
    return sure.filter(keep).withColumn("w", F.lit(weight))


def importance_weights(source: DataFrame, target: DataFrame, features: list[str], most: float = 10.0) -> DataFrame:
    """Source rows with w, the odds that a classifier gives a row for coming from the target."""
    both = source.select(*features, F.lit(0).alias("domain")).unionAll(target.select(*features, F.lit(1).alias("domain")))
    ready, inputs = without_nulls(both, features)
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), LogisticRegression(featuresCol="features", labelCol="domain", regParam=0.01)]).fit(ready)
    odds = F.col("_q") / F.greatest(1 - F.col("_q"), F.lit(1e-6))
    return predict(model, source, features, "_q").withColumn("w", F.least(F.greatest(odds, F.lit(1 / most)), F.lit(most))).drop("_q")
