"""Checks of inputs and outputs: one row per finding, and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.records import read_tsv

# Scripts and encoding damage in names, and noise in names (lower case) and addresses, by pattern.
SCRIPTS = {
    "devanagari": "[\u0900-\u097F]", "bengali": "[\u0980-\u09FF]", "tamil": "[\u0B80-\u0BFF]", "telugu": "[\u0C00-\u0C7F]",
    "kannada": "[\u0C80-\u0CFF]", "gujarati": "[\u0A80-\u0AFF]", "gurmukhi": "[\u0A00-\u0A7F]", "malayalam": "[\u0D00-\u0D7F]",
    "arabic": "[\u0600-\u06FF]", "cjk": "[\u4E00-\u9FFF]", "latin_accent": "[\u00C0-\u017F]", "mojibake": "(?:Ã.|à¤|à¥|Â.)",
}
NAME_NOISE = {
    "leet": r"[a-z][01][a-z]|[a-z][01]\b|\b[01][a-z]{2}", "domain": r"\.(?:com|net|org|in|co|fr|io|biz)\b|^@|www\.",
    "name_trail_num": r"\d{6,}\s*$", "dotted": r"\b(?:[a-z]\.){2,}", "brackets": r"[\[\(]",
}
ADDRESS_NOISE = {"addr_lead0": r"(?:^|[\s,#])0\d+", "addr_null_tok": r"\b[nN][uU][lL][lL]\b", "addr_empty": r"^\s*$"}
NON_ASCII = r"[^\x00-\x7F]"


def audit_id_lists(lists: DataFrame, column: str, all_s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, finding: repeated or unknown S1, missing S1, and repeated, S1 or unknown ids in lists."""
    rows = lists.select(F.col("source1_entity_id").alias("id"), F.filter(F.split(F.col(column), ","), lambda x: x != "").alias("ids"))
    s1 = all_s1.select(F.col("entity_id").alias("id")).distinct()
    find = lambda df, name: df.select(F.col("id").alias("source1_entity_id"), F.lit(name).alias("finding"))
    items = rows.select("id", F.explode("ids").alias("item"))
    out = [
        find(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_s1"),
        find(rows.select("id").distinct().join(s1, "id", "left_anti"), "unknown_s1"),
        find(s1.join(rows.select("id"), "id", "left_anti"), "missing_s1"),
        find(rows.filter(F.size(F.array_distinct("ids")) != F.size("ids")), "repeated_id"),
        find(items.filter(F.col("item").startswith("S1-")).select("id").distinct(), "s1_in_list"),
        find(items.filter(~F.col("item").rlike("^S[123]-")).select("id").distinct(), "wrong_prefix"),
    ]
    if known is not None:
        out.append(find(items.join(known.select(F.col("entity_id").alias("item")), "item", "left_anti").select("id").distinct(), "unknown_id"))
    return reduce(DataFrame.unionAll, out)


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 whose matches are not all among their candidates."""
    both = matches.select("source1_entity_id", F.split("matched_entity_ids", ",").alias("m")).join(candidates.select("source1_entity_id", F.split("candidate_entity_ids", ",").alias("c")), "source1_entity_id", "left")
    extra = F.filter(F.array_except("m", F.coalesce("c", F.array().cast("array<string>"))), lambda x: x != "")
    return both.filter(F.size(extra) > 0).select("source1_entity_id")


def _share(c: Column) -> Column:
    return F.round(F.avg(c.cast("int")), 6)


def profile(records: DataFrame) -> DataFrame:
    """By source: rows, ids, empty names and addresses, mean lengths, and the share of names beyond ASCII."""
    rows = records.withColumn("src", F.substring("entity_id", 1, 2))
    return rows.groupBy("src").agg(
        F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_ids"), _share(F.col("business_name") == "").alias("empty_name"), _share(F.col("business_address") == "").alias("empty_address"),
        F.round(F.avg(F.length("business_name")), 6).alias("mean_name"), F.round(F.avg(F.length("business_address")), 6).alias("mean_address"), _share(F.col("business_name").rlike(NON_ASCII)).alias("non_ascii_name"),
    )


def noise_profile(records: DataFrame) -> DataFrame:
    """By source: shares of names and addresses with each of the fixed patterns."""
    name, lower, address = F.coalesce("business_name", F.lit("")), F.lower(F.coalesce("business_name", F.lit(""))), F.coalesce("business_address", F.lit(""))
    shares = {f"name_{k}": name.rlike(p) for k, p in SCRIPTS.items()} | {k: lower.rlike(p) for k, p in NAME_NOISE.items()} | {k: address.rlike(p) for k, p in ADDRESS_NOISE.items()}
    shares |= {"addr_mojibake": address.rlike(SCRIPTS["mojibake"]), "addr_devanagari": address.rlike(SCRIPTS["devanagari"])}
    return records.groupBy(F.substring("entity_id", 1, 2).alias("src")).agg(F.count("*").alias("n"), *[_share(c).alias(k) for k, c in shares.items()])


def top_countries(records: DataFrame, most: int = 10) -> DataFrame:
    """src, country, n: the `most` commonest of each source; of equals those that sort first."""
    n = records.groupBy(F.substring("entity_id", 1, 2).alias("src"), "country").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "country"))
    return n.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def match_quantiles(truth: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: S1, those without a match, mean, nearest-rank quantiles, maximum, and the share of matches in S2. The
    running sums are over one row per number of matches."""
    per = truth.groupBy("s1_id").agg(F.count("match_id").alias("k"), F.count_if(F.col("match_id").startswith("S2-")).alias("k2"))
    sizes = per.groupBy("k").agg(F.count("*").alias("n"), F.sum("k2").alias("k2"))
    rows = sizes.withColumns({"upto": F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    nearest = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q + 0.5), F.col("k"))).alias(f"p{round(100 * q)}")
    matches = F.sum(F.col("k") * F.col("n"))
    return rows.agg(
        F.sum("n").alias("n_s1"), F.round(F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("singleton_share"), F.round(matches / F.sum("n"), 6).alias("mean_k"),
        *map(nearest, shares), F.max("k").alias("max_k"), F.round(F.sum("k2") / F.greatest(matches, F.lit(1)), 6).alias("s2_share"),
    )


def id_file_findings(spark: SparkSession, path: str, column: str, n_s1: int) -> list[str]:
    """What is wrong with a written list file: its header, a list's form, a repeated id, its rows."""
    head = spark.read.text(path).first()
    names = head[0].split("\t") if head else []
    if names != ["source1_entity_id", column]:
        return [f"header {names}"]
    rows = read_tsv(spark, path, names).select("source1_entity_id", F.coalesce(column, F.lit("")).alias("ids"))
    ids = F.split("ids", ",")
    r = rows.agg(F.count("*").alias("n"), F.countDistinct("source1_entity_id").alias("u"), F.count_if(~F.col("ids").rlike(r"^(?:S[23]-[^,]+(?:,S[23]-[^,]+)*)?$")).alias("form"), F.count_if(F.size(F.array_distinct(ids)) != F.size(ids)).alias("twice")).first()
    return [f"{r.form} malformed lists"] * (r.form > 0) + [f"{r.twice} lists with a repeated id"] * (r.twice > 0) + [f"rows {r.n} unique {r.u} expected {n_s1}"] * (not r.n == r.u == n_s1)


def prep_invariants(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """name, n_bad: ids that are repeated, wrongly prefixed, or unknown to the tables; S1 that the truth lacks; records that
    it gives to several S1."""
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n_bad"))
    every = s1.select("entity_id").unionAll(pool.select("entity_id"))
    known = truth.filter("match_id IS NOT NULL")
    ids = lambda df, c: df.select(F.col("entity_id").alias(c))
    return reduce(DataFrame.unionAll, [
        one(every.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_id"),
        one(s1.filter(~F.col("entity_id").startswith("S1-")), "s1_prefix"),
        one(pool.filter(~F.col("entity_id").rlike("^S[23]-")), "pool_prefix"),
        one(truth.select("s1_id").distinct().join(ids(s1, "s1_id"), "s1_id", "left_anti"), "truth_unknown_s1"),
        one(known.select("match_id").distinct().join(ids(pool, "match_id"), "match_id", "left_anti"), "truth_unknown_match"),
        one(ids(s1, "s1_id").join(truth.select("s1_id").distinct(), "s1_id", "left_anti"), "s1_without_truth"),
        one(exclusivity(truth), "shared_match"),
    ])


def submission_audit(matches: DataFrame, candidates: DataFrame, s1: DataFrame) -> DataFrame:
    """country_n, n_s1, matches and candidates per S1, empty share, matches outside the candidates, and records that
    several S1 of the country claim."""
    people = s1.select(F.col("entity_id").alias("s1_id"), "country_n")
    both = matches.select("s1_id", "cand_id", F.lit(1).alias("m")).join(candidates.select("s1_id", "cand_id", F.lit(1).alias("c")), ["s1_id", "cand_id"], "full")
    per = both.groupBy("s1_id").agg(F.count("m").alias("k"), F.count("c").alias("c"), F.count_if(F.col("m").isNotNull() & F.col("c").isNull()).alias("outside"))
    rows = people.join(per, "s1_id", "left").na.fill(0, ["k", "c", "outside"])
    shared = matches.join(people, "s1_id").groupBy("country_n", "cand_id").agg(F.count("*").alias("n")).filter("n > 1").groupBy("country_n").agg(F.count("*").alias("n_shared"))
    out = rows.groupBy("country_n").agg(F.count("*").alias("n_s1"), F.round(F.avg("k"), 6).alias("matches_per_s1"), F.round(F.avg("c"), 6).alias("cands_per_s1"), F.round(F.count_if(F.col("k") == 0) / F.count("*"), 6).alias("empty_share"), F.sum("outside").alias("n_outside"))
    return out.join(shared, "country_n", "left").na.fill(0, ["n_shared"])


def leak_check(truth: DataFrame) -> DataFrame:
    """src, n, id_corr (between the numbers in the ids of true pairs), same_last3 (share with equal last three digits),
    gap_1 (share of neighbouring ids among an S1's matches of the source)."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    rows = truth.filter("match_id IS NOT NULL").select("s1_id", F.substring("match_id", 1, 2).alias("src"), number("s1_id").alias("a"), number("match_id").alias("b"))
    gap = F.col("b") - F.lag("b").over(Window.partitionBy("s1_id", "src").orderBy("b"))
    held = rows.withColumn("gap", gap)
    return held.groupBy("src").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 4).alias("id_corr"), _share(F.col("a") % 1000 == F.col("b") % 1000).alias("same_last3"), F.round(F.count_if(F.col("gap") == 1) / F.nullif(F.count("gap"), F.lit(0)), 6).alias("gap_1"))


def match_histogram(truth: DataFrame, most: int = 10) -> DataFrame:
    """k (10 and more together), n: S1 by their number of matches."""
    k = truth.groupBy("s1_id").agg(F.count("match_id").alias("k"))
    return k.groupBy(F.least("k", F.lit(most)).cast("long").alias("k")).agg(F.count("*").alias("n"))


def exclusivity(truth: DataFrame) -> DataFrame:
    """Pool records that more than one S1 claims."""
    return truth.filter("match_id IS NOT NULL").groupBy("match_id").agg(F.countDistinct("s1_id").alias("n_s1")).filter("n_s1 > 1")
