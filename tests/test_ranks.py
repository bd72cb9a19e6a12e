from quillstone.operators import pairs


def test_a_rank_sorts_its_rows_once(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", None), ("a", 3.0), ("b", None), ("b", 1.0)], "s1_id string, v double")
    ranked = rows.withColumn("r", pairs.average_rank("v"))
    assert ranked._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
    assert sorted((x.s1_id, x.v or 0.0, float(x.r or 0)) for x in ranked.collect()) == [("a", 0.0, 0.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 3.0, 1.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0)]
