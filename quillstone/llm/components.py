"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import drop, store


SCHEMA = "u long, v long"


def _star(spark: SparkSession, path: str, large: bool) -> str:
    """One step over a table of u > v edges, to a table in its place: to each node's smallest neighbour go its larger
    neighbours (large star) or, with the node itself, its smaller ones (small star). The minima are a table of their own,
    so that both sides of the join that follows are dealt afresh and AQE splits a hub's edges."""
    edges = spark.read.schema(SCHEMA).parquet(path)
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    held = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    least = spark.read.schema("u long, m long").parquet(held)
    if large:
        moved = both.filter(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    after = store(moved.filter("u <> v").distinct(), "edges")
    drop(spark, held)
    drop(spark, path)
    return after


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Links (a, b) -> node, component (smallest node reachable), for every node but the smallest of each component.

    Self-links and repeated links change nothing; an empty table has no nodes. Every step is written to the shared
    folder, so a lost executor repeats one step at most.
    """
    spark = links.sparkSession
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, seen = store(start, "edges"), None
    for _ in range(most_rounds):
        path = _star(spark, _star(spark, path, True), False)
        # Both steps keep the components; when every node points at its component's smallest node, a round changes nothing.
        sums = spark.read.schema(SCHEMA).parquet(path).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return spark.read.schema(SCHEMA).parquet(path).select(F.col("u").alias("node"), F.col("v").alias("component"))
