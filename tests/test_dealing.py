"""Pairs are dealt out before their similarities, also where the joins leave them in one partition."""

from quillstone.operators import pairs
from quillstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_pairs_of_one_partition_are_dealt_out(spark):
    c = registry.context(spark, SF)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = pairs.rerank_similarities(c.candidates.coalesce(1), c.s1, c.pool)
        assert rows.select("r_cc_ratio").rdd.getNumPartitions() > 1
        assert rows.count() == c.candidates.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
