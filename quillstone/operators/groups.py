"""Blocks of S1 records, splits by them, and the second stage's context of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import similarity as sim
from quillstone.functions.text import city
from quillstone.operators.pairs import average_rank


def s1_blocks(s1: DataFrame, most: int = 2000) -> DataFrame:
    """entity_id, country_n, block: country, city and the first letter of the core name; three letters in blocks over
    `most` records."""
    key = lambda n: F.concat_ws("|", "country_n", "city", F.substring("name_core", 1, n))
    rows = s1.select("entity_id", "country_n", "name_core", city(F.col("business_address")).alias("city")).withColumn("_b", key(1))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "_b").select("entity_id", "country_n", F.when(F.col("_n") > most, key(3)).otherwise(F.col("_b")).alias("block"))


def block_split(blocks: DataFrame, most: int, n_val: int) -> DataFrame:
    """entity_id, part: whole blocks of at most `most` records, in the order of their md5, are val until they hold n_val
    records; the rest are train. The running sum is over one row per block of a size that val may take."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    running = F.sum("n").over(Window.orderBy(F.md5("block"), "block").rowsBetween(Window.unboundedPreceding, 0))
    val = sizes.withColumn("c", running).filter(F.col("c") <= n_val).select("block", F.lit("val").alias("part"))
    return blocks.join(val, "block", "left").select("entity_id", F.coalesce("part", F.lit("train")).alias("part"))


def competitor_owners(scored: DataFrame, truth: DataFrame, val: DataFrame, least: float = 0.05) -> DataFrame:
    """s1_id of the S1 outside the validation part that own a record which one of its S1 scores `least` or more: they
    compete for it, though they are not measured."""
    held = val.select(F.col("entity_id").alias("s1_id"))
    hot = scored.filter(F.col("p") >= least).join(held, "s1_id", "left_semi").select(F.col("cand_id").alias("match_id")).distinct()
    return truth.filter("match_id IS NOT NULL").join(hot, "match_id", "left_semi").select("s1_id").distinct().join(held, "s1_id", "left_anti")


def with_competitors(scored: DataFrame, truth: DataFrame, val: DataFrame, least: float = 0.05) -> DataFrame:
    """Scored pairs of the validation S1, and those of their competitors with label 0, for exclusive decisions."""
    held = val.select(F.col("entity_id").alias("s1_id"))
    own = scored.join(held, "s1_id", "left_semi")
    others = scored.join(competitor_owners(scored, truth, val, least), "s1_id", "left_semi").withColumn("label", F.lit(0))
    return own.unionAll(others)


def train_parts(blocks: DataFrame, most: int, n_val: int, n_train: int, seed: int = 42) -> DataFrame:
    """entity_id, part: val by whole blocks, train the first n_train others by hash, every twentieth of those stop (for
    early stopping), and rest."""
    split = block_split(blocks, most, n_val)
    draw = F.xxhash64("entity_id", F.lit(seed))
    others = split.filter("part = 'train'").select("entity_id").orderBy(draw, "entity_id").limit(n_train).withColumn("use", F.lit(1))
    stop = F.pmod(F.xxhash64("entity_id", F.lit(seed + 1)), F.lit(20)) == 0
    part = F.when(F.col("part") == "val", "val").when(F.col("use").isNull(), "rest").when(stop, "stop").otherwise("train")
    return split.join(others, "entity_id", "left").select("entity_id", part.alias("part"))


def scorer_context(scored: DataFrame, second: DataFrame, low: float = 0.02, high: float = 0.995) -> DataFrame:
    """For pairs in the band with a second score: logit, p_gap and s1_nhi from all of an S1's pairs, and the second score's
    average rank, gap to the best, and the size of the band."""
    w = Window.partitionBy("s1_id")
    every = scored.withColumns({"p_gap": F.round(F.max("p").over(w) - F.col("p"), 6), "s1_nhi": F.count_if(F.col("p") >= 0.5).over(w)})
    band = every.filter((F.col("p") >= low) & (F.col("p") < high)).join(second.select("s1_id", "cand_id", "ce"), ["s1_id", "cand_id"])
    return band.withColumns({"lp": F.round(sim.logit(F.col("p")), 6), "ce_rank": average_rank("ce").cast("double"), "ce_gap": F.round(F.max("ce").over(w) - F.col("ce"), 6), "n_band": F.count("*").over(w)})


def stage2_context(scored: DataFrame, least: float = 0.05) -> DataFrame:
    """Each pair's place among its S1's candidates, among the S1 of its block that compete for its record, and the S1's
    best other candidate (ref, p_ref)."""
    df = scored.filter(F.col("p") >= least)
    w = Window.partitionBy("s1_id")
    o = w.orderBy(F.col("p").desc(), "cand_id")
    c = Window.partitionBy("cand_id", "block")
    co = c.orderBy(F.col("p").desc(), "s1_id")
    d = F.col("p").cast("decimal(9,6)")
    df = df.withColumns({
        "r_s1": F.row_number().over(o).cast("long"), "p_max": F.max("p").over(w), "p_sum": F.sum(d).over(w).cast("double"),
        "n_hi": F.sum((F.col("p") > 0.5).cast("long")).over(w), "n_s1": F.count("*").over(w), "gap_next": F.round(F.col("p") - F.lead("p", 1, 0.0).over(o), 6),
        "c_n": F.count("*").over(c), "c_rank": F.row_number().over(co).cast("long"), "_top": F.max("p").over(c), "_second": F.nth_value("p", 2).over(co.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "c_n_hi": F.sum((F.col("p") > 0.3).cast("long")).over(c),
        "_first": F.first("cand_id").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_p2": F.nth_value("p", 2).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_ref2": F.nth_value("cand_id", 2).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    top = F.col("r_s1") == 1
    return df.withColumns({
        "p_ratio": F.round(F.col("p") / F.col("p_max"), 6),
        "c_other": F.when(F.col("c_n") == 1, 0.0).when(F.col("c_rank") == 1, F.col("_second")).otherwise(F.col("_top")),
        "ref": F.when(top, F.col("_ref2")).otherwise(F.col("_first")),
        "p_ref": F.coalesce(F.when(top, F.col("_p2")).otherwise(F.col("p_max")), F.lit(0.0)),
    }).drop("_top", "_second", "_first", "_p2", "_ref2")


def stage2_consistency(context: DataFrame, pool: DataFrame) -> DataFrame:
    """Similarities of a candidate with its S1's best other one; -1 without one."""
    text = lambda n, key: pool.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in ("name_full", "name_core", "addr")])
    rows = context.select("s1_id", "cand_id", "ref").join(text(1, "cand_id"), "cand_id").join(text(2, "ref"), "ref", "left")
    pair = lambda f, a: F.when(F.col("ref").isNull(), F.lit(-1.0)).otherwise(f(F.col(f"{a}_1"), F.col(f"{a}_2")))
    return rows.select("s1_id", "cand_id", pair(sim.sim_ratio, "name_core").alias("ref_nc_ratio"), pair(sim.sim_token_set, "name_core").alias("ref_nc_tset"), pair(sim.sim_token_set, "addr").alias("ref_ad_tset"), pair(sim.sim_token_sort, "name_full").alias("ref_nf_tsort"))


def band_overlay(scored: DataFrame, rescored: DataFrame, low: float = 0.02, high: float = 0.995) -> DataFrame:
    """p replaced by a second model's p2 inside the band where the first is unsure."""
    second = rescored.select("s1_id", "cand_id", "p2")
    joined = scored.join(second, ["s1_id", "cand_id"], "left")
    inside = (F.col("p") >= low) & (F.col("p") < high)
    return joined.withColumn("p", F.when(inside, F.coalesce("p2", "p")).otherwise(F.col("p"))).drop("p2")
