"""Files that runs read and leave behind, models, and what has no SQL."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators import audit, groups, learn, metrics
from quillstone.plans import registry
from quillstone.sources import outputs
from quillstone.sources.records import read_records, read_tsv, write_id_lists

SF = "/root/testdata/sf0.001"


def test_tab_separated_text(spark, tmp_path):
    """No quoting: quotes and backslashes are text; short lines have nulls; further fields go; empty is null or empty."""
    (tmp_path / "r.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t\"Acme\\ \"Co\t12 \"A\tUS\nS1-2\tx\nS1-3\ta\tb\tc\td\te\nS1-4\t\t\t\n")
    got = sorted(tuple(r) for r in read_records(spark, str(tmp_path / "r.tsv")).collect())
    assert got == [("S1-1", '"Acme\\ "Co', '12 "A', "US"), ("S1-2", "x", "", ""), ("S1-3", "a", "b", "c"), ("S1-4", "", "", "")]
    assert [r.business_name for r in read_tsv(spark, str(tmp_path / "r.tsv"), ["entity_id", "business_name"]).filter("entity_id = 'S1-4'").collect()] == [None]


def test_list_files_and_their_check(spark, tmp_path):
    lists = spark.createDataFrame([("S1-2", "S2-1,S3-1"), ("S1-1", "")], "source1_entity_id string, matched_entity_ids string")
    write_id_lists(lists, str(tmp_path / "good"))
    back = read_tsv(spark, str(tmp_path / "good"), lists.columns).collect()
    assert sorted((r[0], r[1] or "") for r in back) == [("S1-1", ""), ("S1-2", "S2-1,S3-1")]
    check = lambda text, n: (tmp_path / "f.tsv").write_text(text) and audit.id_file_findings(spark, str(tmp_path / "f.tsv"), "matched_entity_ids", n)
    head = "source1_entity_id\tmatched_entity_ids\n"
    assert check(head + "S1-1\tS2-1\nS1-2\t\n", 2) == []
    assert check("a\tb\nS1-1\tS2-1\n", 1) == ["header ['a', 'b']"]
    assert check(head + "S1-1\tS1-9\nS1-1\tS2-1,S2-1\n", 2) == ["1 malformed lists", "1 lists with a repeated id", "rows 2 unique 1 expected 2"]


def test_spills_registry_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1, 0.9, "us"), ("a", "y", 2, 0.01, "fr")], "s1_id string, cand_id string, brank int, p double, country_n string")
    outputs.write_features(rows, str(tmp_path / "f"))
    outputs.write_features(rows.filter("country_n = 'fr'").withColumn("p", F.lit(0.5)), str(tmp_path / "f"))  # the other country stays
    assert sorted((r.s1_id, r.cand_id, r.p) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("a", "x", 0.9), ("a", "y", 0.5)]
    outputs.write_predictions(rows, str(tmp_path / "p"))
    candidates, scored = outputs.read_predictions(spark, str(tmp_path / "p"))
    assert candidates.count() == 2 and [r.cand_id for r in scored.collect()] == ["x"]
    for run, f05 in (("one", 0.5), ("two", 0.75), ("one", 0.625)):
        outputs.record_run(spark, str(tmp_path / "runs"), run, f05=f05, mode="threshold")
    assert [tuple(r) for r in outputs.leaderboard(spark, str(tmp_path / "runs"), "f05").collect()] == [("two", 0.75), ("one", 0.625)]
    assert outputs.index_name("test", "us", 3, 2, 600) != outputs.index_name("test", "us", 3, 2, 150)
    (tmp_path / "doc.md").write_text("text")
    outputs.archive({"rows.tsv": rows.select("s1_id", "cand_id").orderBy("cand_id")}, [str(tmp_path / "doc.md")], str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as held:
        assert held.read("rows.tsv") == b"s1_id\tcand_id\na\tx\na\ty\n" and held.read("doc.md") == b"text"


@pytest.fixture(scope="module")
def learning(spark):
    rows = [(f"S1-{i}", f"S2-{i}-{j}", (i * 7 + j * 13) % 10 / 10, (i + j) % 3 / 3, f"b{i % 9}", "us" if i % 2 else "india") for i in range(60) for j in range(6)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, x double, z double, block string, country_n string")
    return df.withColumn("label", (F.col("x") + F.col("z") > 0.8).cast("int"))


def test_models_are_saved_and_stop_early(spark, learning, tmp_path):
    split = learning.withColumn("stop", F.pmod(F.xxhash64("s1_id"), F.lit(5)) == 0)
    model = learn.train_matcher(split, ["x", "z"], rounds=30, depth=2, stop="stop")
    learn.save_model(model, str(tmp_path / "m"), features=["x", "z"], threshold=0.5)
    back, about = learn.load_model(str(tmp_path / "m"))
    scores = lambda m: sorted(tuple(r) for r in learn.predict(m, learning, ["x", "z"]).select("s1_id", "cand_id", "p").collect())
    assert scores(back) == scores(model) and about == {"features": ["x", "z"], "threshold": 0.5}
    assert model.stages[-1].getNumTrees <= 30
    for kind in ("forest", "linear"):
        own = learn.predict(learn.train_matcher(learning, ["x", "z"], rounds=5, kind=kind), learning, ["x", "z"])
        ones, zeros = (own.filter(F.col("label") == y).agg(F.avg("p")).first()[0] for y in (1, 0))
        assert ones > zeros + 0.3


def test_folds_never_see_their_own_block(learning):
    seen = []

    def train(rows):
        seen.append({r.block for r in rows.select("block").distinct().collect()})
        return learn.train_matcher(rows, ["x", "z"], kind="linear")

    scored, models = learn.out_of_fold(learning, ["x", "z"], train, folds=3)
    held = {k: {r.block for r in learning.filter(learn.fold_of(F.col("block"), 3) == k).select("block").distinct().collect()} for k in range(3)}
    assert all(not seen[k] & held[k] for k in range(3)) and scored.count() == learning.count()
    mean = learn.mean_of_models(models, learning, ["x", "z"]).collect()
    assert all(0 <= r.p <= 1 for r in mean) and len(mean) == 360


def test_experiments(learning):
    auc = lambda df: float(df.agg(F.corr("p", "label")).first()[0])
    found = learn.feature_ablation(learning, {"first": ["x"], "second": ["z"]}, auc, F.col("block") < "b5")
    assert found["all"] > max(found["first"], found["second"])
    assert set(learn.leave_one_out(learning, "country_n", ["x", "z"], auc)) == {"us", "india"}
    source, target = learning.filter("country_n = 'us'"), learning.filter("country_n = 'india'").withColumn("x", F.col("x") + 0.5)
    weights = learn.importance_weights(source, target, ["x", "z"]).select("x", "w").collect()
    assert all(0.1 <= r.w <= 10 for r in weights)
    assert sum(r.w for r in weights if r.x > 0.6) / sum(r.x > 0.6 for r in weights) > sum(r.w for r in weights if r.x < 0.3) / sum(r.x < 0.3 for r in weights)
    pseudo = learn.pseudo_labels(learning.withColumn("p", F.col("x")).drop("label"), high=0.85, low=0.25, negatives=1.0).collect()
    assert {r.label for r in pseudo} == {0, 1} and all(r.w == 0.5 and (r.p >= 0.85) == (r.label == 1) for r in pseudo)


def test_parts_and_competitors(spark):
    c = registry.context(spark, SF)
    parts = groups.train_parts(groups.s1_blocks(c.s1, 20), 15, 60, 100)
    n = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert 0 < n["val"] <= 60 and n["train"] + n["stop"] == min(100, parts.count() - n["val"]) and set(n) <= {"val", "train", "stop", "rest"}
    rows = learn.reranker_sample(parts, c.s1, 5).groupBy("country_n").count().collect()
    assert all(r["count"] <= 5 for r in rows)
    joint = groups.with_competitors(c.scored, c.truth, c.val)
    own = {r.entity_id for r in c.val.collect()}
    assert joint.filter(~F.col("s1_id").isin(*own)).filter("label = 1").count() == 0
    recall = learn.reranker_recall(c.scored.filter("p >= 0.5"), c.scored, c.truth).first()
    assert 0 < recall.kept_recall <= recall.wide_recall <= 1


def test_second_scorer_restacks_the_band(spark):
    c = registry.context(spark, SF)
    before = {(r.s1_id, r.cand_id): r.p for r in c.scored.collect()}
    after = {(r.s1_id, r.cand_id): r.p for r in registry.queries()["restacked_scores"](spark, SF).collect()}
    assert before.keys() == after.keys() and all(0 <= p <= 1 for p in after.values())
    assert all(after[k] == p for k, p in before.items() if not 0.02 <= p < 0.995) and before != after


def test_categories_add_up(spark):
    c = registry.context(spark, SF)
    rows = metrics.s1_categories(c.candidates, c.selected, c.counts, c.truth).collect()
    f05 = metrics.macro_f05(c.selected, c.counts).first().f05
    assert sum(r.n for r in rows) == c.s1.count() and abs(1 - sum(r.lost for r in rows) - f05) < 1e-5
