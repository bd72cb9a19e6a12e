"""Evaluation of selections against a truth, and where their errors come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label: 1 where the pair is in the truth."""
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("label")).distinct()
    return pairs.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def truth_counts(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """s1_id, country_n, n_true for every S1, also those without a match."""
    n = truth.groupBy("s1_id").agg(F.count("match_id").alias("n_true"))
    return s1.select(F.col("entity_id").alias("s1_id"), "country_n").join(n, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0).cast("long")))


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    return F.when((n_true == 0) & (n_pred == 0), 1.0).otherwise(F.round(1.25 * tp / F.greatest(0.25 * n_true + n_pred, F.lit(1e-9)), 9))


def per_s1(selected: DataFrame, counts: DataFrame) -> DataFrame:
    """counts with n_pred, tp and f of each S1; S1 that are not in counts do not count."""
    agg = selected.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    joined = counts.join(agg, "s1_id", "left").na.fill(0, ["n_pred", "tp"])
    return joined.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")).cast("decimal(18,9)"))


def macro_f05(selected: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """n_s1, f05 (macro), precision and recall (micro), over all or by columns of counts."""
    share = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)
    mean = F.round(F.sum("f").cast("double") / F.count("*"), 6)
    return per_s1(selected, counts).groupBy(*by).agg(F.count("*").alias("n_s1"), mean.alias("f05"), share("tp", "n_pred").alias("precision"), share("tp", "n_true").alias("recall"))


def weighted_f05(selected: DataFrame, counts: DataFrame, weight: Column) -> DataFrame:
    """Macro F with a weight for each S1."""
    rows = per_s1(selected, counts).withColumn("_w", weight.cast("decimal(9,4)"))
    return rows.agg(F.round(F.sum((F.col("f") * F.col("_w")).cast("decimal(28,13)")).cast("double") / F.sum("_w").cast("double"), 6).alias("f05"))


def loss_buckets(pairs: DataFrame, selected: DataFrame, truth: DataFrame) -> DataFrame:
    """bucket, n over all candidate and true pairs: tp, fp, tn, model_fn, block_miss."""
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("is_true")).distinct()
    chosen = selected.select("s1_id", "cand_id", F.lit(1).alias("chosen"))
    rows = pairs.select("s1_id", "cand_id", F.lit(1).alias("is_cand")).join(true, ["s1_id", "cand_id"], "full").join(chosen, ["s1_id", "cand_id"], "left")
    t, c = F.col("is_true").isNotNull(), F.col("chosen").isNotNull()
    bucket = F.when(F.col("is_cand").isNull(), "block_miss").when(t & c, "tp").when(t, "model_fn").when(c, "fp").otherwise("tn")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def s1_categories(pairs: DataFrame, selected: DataFrame, counts: DataFrame, truth: DataFrame) -> DataFrame:
    """category, n, lost: what an S1's score suffers from first (all S1 without a match are together), and the macro F
    that its category costs."""
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id")).distinct()
    missed = true.join(pairs.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").groupBy("s1_id").agg(F.count("*").alias("n_bm"))
    rows = per_s1(selected, counts).join(missed, "s1_id", "left").na.fill(0, ["n_bm"])
    n_fn = F.col("n_true") - F.col("tp") - F.col("n_bm")
    category = F.when(F.col("n_true") == 0, "singleton_fp").when(F.col("tp") == 0, "no_tp").when(F.col("n_pred") > F.col("tp"), "has_fp").when(F.col("n_bm") > 0, "block_miss_only").when(n_fn > 0, "model_fn_only").otherwise("perfect")
    total = counts.agg(F.count("*").alias("all_s1"))
    per = rows.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum(1 - F.col("f")).cast("double").alias("lost"))
    return per.join(F.broadcast(total), F.lit(True)).select("category", "n", F.round(F.col("lost") / F.col("all_s1"), 6).alias("lost"))


def loss_ablation(pairs: DataFrame, selected: DataFrame, counts: DataFrame, truth: DataFrame) -> DataFrame:
    """Macro F if false positives were left out, if missed candidates were chosen, if both, and if the true pairs that
    blocking lost were chosen too."""
    no_fp = selected.filter("label = 1")
    missed = pairs.filter("label = 1").join(selected.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    whole = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("label")).distinct()
    cols = ["s1_id", "cand_id", "label"]
    cases = {"as_is": selected.select(*cols), "no_fp": no_fp.select(*cols), "no_fn": selected.select(*cols).unionAll(missed.select(*cols)), "perfect_model": no_fp.select(*cols).unionAll(missed.select(*cols)), "perfect_blocking": whole}
    out = [macro_f05(s, counts).select(F.lit(name).alias("what"), "f05") for name, s in cases.items()]
    return reduce(DataFrame.unionAll, out)


def fp_origin(selected: DataFrame, truth: DataFrame, val: DataFrame) -> DataFrame:
    """origin, n, mean_p of false positives: records that another S1 of the validation part owns, or one outside it, or none."""
    owner = truth.filter("match_id IS NOT NULL").select(F.col("match_id").alias("cand_id"), F.col("s1_id").alias("owner")).distinct()
    held = val.select(F.col("entity_id").alias("owner"), F.lit(1).alias("in_val"))
    rows = selected.filter("label = 0").join(owner, "cand_id", "left").join(held, "owner", "left")
    origin = F.when(F.col("owner").isNull(), "distractor").when(F.col("in_val") == 1, "other_val_s1").otherwise("non_val_s1")
    return rows.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("p").cast("decimal(9,6)")).cast("double") / F.count("*"), 6).alias("mean_p"))


def match_numbers(lists: DataFrame, population: DataFrame, most: int = 7) -> DataFrame:
    """country_n, k (`most` and more together), share of the country's S1 with k selected records."""
    k = lists.groupBy("s1_id").agg(F.count("*").alias("k"))
    rows = population.select(F.col("entity_id").alias("s1_id"), "country_n").join(k, "s1_id", "left").select("country_n", F.least(F.coalesce("k", F.lit(0)), F.lit(most)).cast("long").alias("k"))
    sizes = rows.groupBy("country_n").agg(F.count("*").alias("n"))
    return rows.groupBy("country_n", "k").agg(F.count("*").alias("c")).join(sizes, "country_n").select("country_n", "k", F.round(F.col("c") / F.col("n"), 6).alias("share"))


def selection_change(a: DataFrame, b: DataFrame, population: DataFrame) -> DataFrame:
    """country_n, changed (share of S1 whose selections differ), and the mean numbers k_a and k_b."""
    both = a.select("s1_id", "cand_id", F.lit(1).alias("in_a")).join(b.select("s1_id", "cand_id", F.lit(1).alias("in_b")), ["s1_id", "cand_id"], "full")
    per = both.groupBy("s1_id").agg(F.count("in_a").alias("k_a"), F.count("in_b").alias("k_b"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("other"))
    rows = population.select(F.col("entity_id").alias("s1_id"), "country_n").join(per, "s1_id", "left").na.fill(0, ["k_a", "k_b", "other"])
    return rows.groupBy("country_n").agg(F.round(F.count_if(F.col("other") > 0) / F.count("*"), 6).alias("changed"), F.round(F.avg("k_a"), 6).alias("k_a"), F.round(F.avg("k_b"), 6).alias("k_b"))


def ensemble(scored: list[DataFrame], missing: float = 0.01, least: float = 0.02) -> DataFrame:
    """Mean p over several models' pairs; a missing pair counts as `missing`, means below `least` go."""
    p = F.round((F.sum(F.col("p").cast("decimal(9,6)")).cast("double") + missing * (len(scored) - F.count("*"))) / len(scored), 9)
    rows = reduce(DataFrame.unionAll, [s.select("s1_id", "cand_id", "p") for s in scored])
    return rows.groupBy("s1_id", "cand_id").agg(p.alias("p")).filter(F.col("p") >= least)


def shape(lists: DataFrame, population: DataFrame) -> DataFrame:
    """country_n, n_s1, mean_k, empty_share, s2_share of a selection."""
    k = lists.groupBy("s1_id").agg(F.count("*").alias("k"), F.count_if(F.col("cand_id").startswith("S2-")).alias("k2"))
    rows = population.select(F.col("entity_id").alias("s1_id"), "country_n").join(k, "s1_id", "left").na.fill(0, ["k", "k2"])
    return rows.groupBy("country_n").agg(F.count("*").alias("n_s1"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.count_if(F.col("k") == 0) / F.count("*"), 6).alias("empty_share"), F.round(F.sum("k2") / F.greatest(F.sum("k"), F.lit(1)), 6).alias("s2_share"))
