"""Decision rules over scored pairs (s1_id, cand_id, p). Ties in p go to the smaller id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rules that tune_rules() tries.
THRESHOLDS = [round(0.05 + 0.025 * i, 3) for i in range(37)]
ALPHAS = [0.0, 0.1, 0.25, 0.5, 1.0, 2.0]
TOP1 = [0.2, 0.3, 0.4, 0.5, 0.6]
PAIRS = [(t, t1) for t in THRESHOLDS if t >= 0.5 for t1 in TOP1 if t1 < t]


@dataclass(frozen=True)
class Decision:
    """mode: threshold (t), thr_top1 (t, and t1 for an S1's best) or expected_f (alpha)."""

    mode: str
    t: float
    t1: float = 1.0
    exclusive: bool = False
    floor: float = 0.02


def _of(key: str):
    return Window.partitionBy(key).orderBy(F.col("p").desc(), "cand_id" if key == "s1_id" else "s1_id")


def exclusive(scored: DataFrame) -> DataFrame:
    """Each pool record only for the S1 that scores it best."""
    return scored.withColumn("_r", F.row_number().over(_of("cand_id"))).filter("_r = 1").drop("_r")


def threshold(scored: DataFrame, t: float) -> DataFrame:
    return scored.filter(F.col("p") >= t)


def threshold_or_best(scored: DataFrame, t: float, t1: float) -> DataFrame:
    """p >= t, or an S1's best candidate with p >= t1."""
    ranked = scored.withColumn("_r", F.row_number().over(_of("s1_id")))
    return ranked.filter((F.col("p") >= t) | ((F.col("_r") == 1) & (F.col("p") >= t1))).drop("_r")


def expected_f(scored: DataFrame, alpha: float) -> DataFrame:
    """The prefix of an S1's ranked candidates that maximises 1.25 E[tp] / (0.25 (sum p + alpha) + m); none if having no
    match is likelier than that."""
    running, whole = _of("s1_id").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("s1_id")
    d = F.col("p").cast("decimal(9,6)")
    s = scored.withColumns({"_m": F.row_number().over(_of("s1_id")), "_tp": F.sum(d).over(running).cast("double"), "_k": F.sum(d).over(whole).cast("double"), "_none": F.sum(F.round(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))), 9).cast("decimal(18,9)")).over(whole).cast("double")})
    s = s.withColumn("_f", F.round(1.25 * F.col("_tp") / (0.25 * (F.col("_k") + alpha) + F.col("_m")), 9))
    s = s.withColumns({"_best": F.max("_f").over(whole), "_at": F.max_by("_m", F.struct("_f", -F.col("_m"))).over(whole)})
    return s.filter((F.col("_best") > F.exp(F.col("_none") - alpha)) & (F.col("_m") <= F.col("_at"))).drop("_m", "_tp", "_k", "_none", "_f", "_best", "_at")


def apply_decision(scored: DataFrame, d: Decision) -> DataFrame:
    """Exclusivity first (over p >= floor), then the rule of each S1."""
    if d.exclusive:
        scored = exclusive(scored.filter(F.col("p") >= d.floor))
    if d.mode == "threshold":
        return threshold(scored, d.t)
    if d.mode == "thr_top1":
        return threshold_or_best(scored, d.t, d.t1)
    if d.mode == "expected_f":
        return expected_f(scored.filter(F.col("p") >= d.floor), d.t)
    raise ValueError(d.mode)


def tune_grid(scored: DataFrame, counts: DataFrame, thresholds: list[float], floor: float = 0.02) -> DataFrame:
    """excl, t, f05 for every threshold with and without exclusivity, in one job: pairs are expanded by the grid (a
    literal array), aggregated per S1 and rule, and S1 without a selected pair are added in closed form."""
    both = scored.select("s1_id", "p", "label", F.lit(False).alias("excl")).unionAll(exclusive(scored.filter(F.col("p") >= floor)).select("s1_id", "p", "label", F.lit(True)))
    grid = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("p") >= t)).alias("t")
    chosen = both.select("s1_id", "label", "excl", grid).groupBy("excl", "t", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    f = F.round(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("n_pred")), 9).cast("decimal(18,9)")
    with_pred = chosen.join(counts, "s1_id").groupBy("excl", "t").agg(F.sum(f).alias("s"), F.count_if(F.col("n_true") == 0).alias("wrong"))
    totals = counts.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("none"))
    return with_pred.join(F.broadcast(totals), F.lit(True)).select("excl", "t", F.round((F.col("s").cast("double") + F.col("none") - F.col("wrong")) / F.col("n"), 6).alias("f05"))


def tune_rules(scored: DataFrame, counts: DataFrame, floor: float = 0.02) -> DataFrame:
    """excl, mode, t, t1, n_pred, tp, f05 of all rules, with and without exclusivity, in one job. Each pair is expanded by
    the rules that select it; rows are summed per rule and S1 before S1 without a selected pair are added in closed form.
    Rules that select nothing have no row."""
    ranked = scored.withColumn("_r", F.row_number().over(_of("s1_id")))
    rule = lambda mode, t, t1: F.struct(F.lit(mode).alias("mode"), F.lit(float(t)).alias("t"), F.lit(float(t1)).alias("t1"))
    plain, rescue = F.array(*[rule("threshold", t, 1) for t in THRESHOLDS]), F.array(*[rule("thr_top1", *x) for x in PAIRS])
    columns = ["s1_id", "label", "excl", "rule"]

    def chosen(base: DataFrame, excl: bool) -> DataFrame:
        fixed = F.concat(F.filter(plain, lambda r: F.col("p") >= r["t"]), F.filter(rescue, lambda r: (F.col("p") >= r["t"]) | ((F.col("_r") == 1) & (F.col("p") >= r["t1"]))))
        rows = [base.withColumns({"excl": F.lit(excl), "rule": F.explode(fixed)}).select(*columns)]
        above = base.filter(F.col("p") >= floor)
        rows += [expected_f(above, a).withColumns({"excl": F.lit(excl), "rule": rule("expected_f", a, 1)}).select(*columns) for a in ALPHAS]
        return reduce(DataFrame.unionAll, rows)

    alone = exclusive(scored.filter(F.col("p") >= floor))
    both = chosen(ranked, False).unionAll(chosen(alone.withColumn("_r", F.row_number().over(_of("s1_id"))), True))
    per = both.groupBy("excl", "rule", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp")).join(counts, "s1_id")
    f = F.round(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("n_pred")), 9).cast("decimal(18,9)")
    sums = per.groupBy("excl", "rule").agg(F.sum(f).cast("double").alias("s"), F.count_if(F.col("n_true") == 0).alias("wrong"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))
    totals = counts.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("none"))
    return sums.join(F.broadcast(totals), F.lit(True)).select("excl", "rule.mode", "rule.t", "rule.t1", "n_pred", "tp", F.round((F.col("s") + F.col("none") - F.col("wrong")) / F.col("n"), 6).alias("f05"))


def best_of_each_mode(rules: DataFrame) -> DataFrame:
    """The best rule of each mode with and without exclusivity; of equals the one with the smallest parameters."""
    best = F.max_by(F.struct("t", "t1", "f05"), F.struct("f05", -F.col("t"), -F.col("t1")))
    return rules.groupBy("mode", "excl").agg(best.alias("b")).select("mode", "excl", "b.t", "b.t1", "b.f05")


def labelled_countries(val: DataFrame) -> DataFrame:
    """country_n of the S1 that the decision was tuned on."""
    return val.filter("country_n IS NOT NULL AND country_n <> ''").select("country_n").distinct()


#: Thresholds and rescue floors that prior_matched() tries.
PRIOR_T, PRIOR_T1 = [round(0.5 + 0.005 * i, 3) for i in range(99)], [0.5, 0.6, 0.7, 0.8]


def prior_matched(scored: DataFrame, population: DataFrame, tuned: float, labelled: DataFrame) -> DataFrame:
    """country_n, t, t1 for countries without labels: the rule whose matches per S1 and share of empty S1 are closest,
    in relation, to those of the labelled countries under the tuned threshold. scored has country_n and is exclusive."""
    sizes = population.groupBy("country_n").agg(F.count("*").alias("n_s1"))
    held = scored.withColumn("_r", F.row_number().over(_of("s1_id")))
    known = labelled.withColumn("known", F.lit(True))
    rule = lambda t, t1: F.struct(F.lit(float(t)).alias("t"), F.lit(float(t1)).alias("t1"))
    grid = F.array(*[rule(t, t1) for t in PRIOR_T for t1 in (1.0, *[x for x in PRIOR_T1 if x < t])])
    met = lambda r: (F.col("p") >= r["t"]) | ((F.col("_r") == 1) & (F.col("p") >= r["t1"]))
    shape = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("k"), F.count_if(F.col("_r") == 1).alias("some"))
    target = shape(held.join(known, "country_n", "left_semi").filter(F.col("p") >= tuned), "country_n").join(sizes, "country_n").agg((F.sum("k") / F.sum("n_s1")).alias("mean_k"), (1 - F.sum("some") / F.sum("n_s1")).alias("empty"))
    other = held.join(known, "country_n", "left_anti").withColumn("rule", F.explode(F.filter(grid, met)))
    tried = shape(other, "country_n", "rule").join(sizes, "country_n").join(F.broadcast(target), F.lit(True))
    gap = F.abs(F.col("k") / F.col("n_s1") - F.col("mean_k")) / F.col("mean_k") + F.abs(1 - F.col("some") / F.col("n_s1") - F.col("empty")) / F.greatest("empty", F.lit(1e-3))
    best = tried.groupBy("country_n").agg(F.min(F.struct(F.round(gap, 9).alias("gap"), "rule.t", "rule.t1")).alias("b"))
    return best.select("country_n", "b.t", "b.t1", "b.gap")


def best_rules(grid: DataFrame) -> DataFrame:
    """The best threshold with and without exclusivity; the lowest of equals."""
    return grid.groupBy("excl").agg(F.max(F.struct("f05", (-F.col("t")).alias("m"))).alias("b")).select("excl", (-F.col("b.m")).alias("t"), F.col("b.f05").alias("f05"))


def shape_matched(scored: DataFrame, population: DataFrame, tuned: float, labelled: DataFrame, most: float = 0.99, step: float = 0.005) -> DataFrame:
    """country_n, t: the tuned threshold for labelled countries; for others the one from it to `most` whose matches per
    S1 are closest to the labelled mean."""
    n = int(round((most - tuned) / step)) + 1
    grid = [round(tuned + step * i, 6) for i in range(n)]
    sizes = population.groupBy("country_n").agg(F.count("*").alias("n_s1"))
    expanded = scored.select("country_n", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("p") >= t)).alias("t"))
    per = expanded.groupBy("country_n", "t").agg(F.count("*").alias("k"))
    mean = per.filter(F.col("t") == tuned).join(labelled, "country_n", "left_semi").join(sizes, "country_n").agg((F.sum("k") / F.sum("n_s1")).alias("target"))
    other = per.join(labelled, "country_n", "left_anti").join(sizes, "country_n").join(F.broadcast(mean), F.lit(True)).withColumn("gap", F.round(F.abs(F.col("k") / F.col("n_s1") - F.col("target")), 9))
    best = other.groupBy("country_n").agg(F.min(F.struct("gap", "t")).alias("b")).select("country_n", F.col("b.t").alias("t"))
    return sizes.join(labelled, "country_n", "left_semi").select("country_n", F.lit(tuned).alias("t")).unionAll(best)
