"""Features of candidate pairs and of their groups. Missing values are nulls where the meaning is "unknown"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import similarity as sim
from quillstone.functions.maps import LEGAL
from quillstone.functions.text import compact, house_number, initials, words
from quillstone.sources.tables import settled, small

FIELDS = ["name_full", "name_core", "name_skel", "addr", "postcode", "addr_nums", "country_n", "src"]
LEGAL_TOKENS = sorted(set(LEGAL.values()))


def name_counts(records: DataFrame, alias: str) -> DataFrame:
    """country_n, name_core, and how many records of the country have it."""
    return records.groupBy("country_n", "name_core").agg(F.count("*").alias(alias))


def address_stop_tokens(s1: DataFrame, share: float = 0.002, least: int = 20) -> DataFrame:
    """country_n, token, df: address tokens without digits in max(least, share * n) S1 records of a country or more."""
    n = s1.groupBy("country_n").agg(F.count("*").alias("n"))
    df = s1.select("country_n", F.explode(F.array_distinct(words(F.col("addr")))).alias("token")).filter(~F.col("token").rlike("[0-9]")).groupBy("country_n", "token").agg(F.count("*").alias("df"))
    return df.join(n, "country_n").filter(F.col("df") >= F.greatest(F.lit(float(least)), share * F.col("n"))).select("country_n", "token", "df")


def name_vocabulary(s1: DataFrame) -> DataFrame:
    """country_n, token: every word of an S1 core name."""
    return s1.select("country_n", F.explode(words(F.col("name_core"))).alias("token")).distinct()


def unknown_share(pool: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """entity_id, c_oov_frac: share of a pool record's name tokens that no S1 of its country has; once per record."""
    rows = pool.select("entity_id", "country_n", F.explode(words(F.col("name_core"))).alias("token"))
    known = vocabulary.withColumn("known", F.lit(1))
    return rows.join(known, ["country_n", "token"], "left").groupBy("entity_id").agg(F.round(F.count_if(F.col("known").isNull()) / F.count("*"), 6).alias("c_oov_frac"))


def joined(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with the fields of both records, suffixed 1 and 2; addr_core where they have it."""
    side = lambda df, key, n: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in [*FIELDS, "addr_core"] if c in df.columns])
    return pairs.join(side(s1, "s1_id", 1), "s1_id").join(side(pool, "cand_id", 2), "cand_id")


def dealt(rows: DataFrame) -> DataFrame:
    """Joined pairs dealt by S1: whichever side of the join was broadcast, the similarities run in many tasks."""
    return rows.repartition("s1_id")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def exact_features(rows: DataFrame) -> DataFrame:
    """Equalities, lengths, legal forms, house numbers and initials: built-in expressions only."""
    hn = {n: house_number(F.col(f"addr_{n}")) for n in (1, 2)}
    legal = {n: F.array_distinct(F.filter(words(F.col(f"name_full_{n}")), lambda t: t.isin(LEGAL_TOKENS))) for n in (1, 2)}
    rows = rows.withColumns({"hn_1": hn[1], "hn_2": hn[2], "_l1": legal[1], "_l2": legal[2], "_n1": words(F.col("addr_nums_1")), "_n2": words(F.col("addr_nums_2")), "_i1": initials(F.col("name_core_1")), "_c2": compact(F.col("name_core_2"))})
    both_legal = (F.size("_l1") > 0) & (F.size("_l2") > 0)
    same_legal = (F.size(F.array_except("_l1", "_l2")) == 0) & (F.size(F.array_except("_l2", "_l1")) == 0)
    first = lambda n: F.split(F.col(f"name_core_{n}"), " ")[0]
    return rows.withColumns({
        "nc_first_eq": flag(first(1) == first(2)),
        "pc_eq": flag((F.col("postcode_1") == F.col("postcode_2")) & (F.col("postcode_1") != "")),
        "pc_both": flag((F.col("postcode_1") != "") & (F.col("postcode_2") != "")),
        "num_jacc": F.round(sim.jaccard(F.col("_n1"), F.col("_n2")), 6),
        "num_both": flag((F.size("_n1") > 0) & (F.size("_n2") > 0)),
        "hn_eq": flag(F.col("hn_1") == F.col("hn_2")),
        "hn_both": flag(F.col("hn_1").isNotNull() & F.col("hn_2").isNotNull()),
        "hn_prefix": flag((F.col("hn_1") != F.col("hn_2")) & (F.startswith("hn_1", "hn_2") | F.startswith("hn_2", "hn_1"))),
        "init_pref": flag((F.length("_i1") >= 2) & (F.length("_i1") < F.length("name_core_1")) & F.startswith("_c2", "_i1")),
        "legal_eq": flag(both_legal & same_legal),
        "legal_conflict": flag(both_legal & (F.size(F.array_intersect("_l1", "_l2")) == 0)),
        "len_name_s1": F.length("name_full_1").cast("long"), "len_name_c": F.length("name_full_2").cast("long"),
        "len_addr_s1": F.length("addr_1").cast("long"), "len_addr_c": F.length("addr_2").cast("long"),
        "addr_empty_any": flag((F.col("addr_1") == "") | (F.col("addr_2") == "")),
        "is_s3": flag(F.col("src_2") == "S3"),
        "same_country": flag(F.col("country_n_1") == F.col("country_n_2")),
    }).drop("_l1", "_l2", "_n1", "_n2", "_i1", "_c2")


def fuzzy_features(rows: DataFrame) -> DataFrame:
    """Similarities of names and addresses, in Arrow functions that compute each distinct pair of a batch once."""
    pair = lambda f, a: f(F.col(f"{a}_1"), F.col(f"{a}_2"))
    rows = rows.withColumns({"_cc_1": compact(F.col("name_core_1")), "_cc_2": compact(F.col("name_core_2"))})
    two = lambda f: f(F.col("_cc_1"), F.col("_cc_2"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.withColumns({
        "nf_ratio": pair(sim.sim_ratio, "name_full"), "nf_tset": pair(sim.sim_token_set, "name_full"), "nf_tsort": pair(sim.sim_token_sort, "name_full"),
        "nf_partial": pair(sim.sim_partial, "name_full"), "nf_jw": pair(sim.sim_jaro_winkler, "name_full"),
        "nc_ratio": pair(sim.sim_ratio, "name_core"), "nc_tset": pair(sim.sim_token_set, "name_core"), "nc_jw": pair(sim.sim_jaro_winkler, "name_core"),
        "ad_ratio": pair(sim.sim_ratio, "addr"), "ad_tset": pair(sim.sim_token_set, "addr"), "ad_partial": pair(sim.sim_partial, "addr"),
        "ncc_ratio": two(sim.sim_ratio), "ncc_partial": two(sim.sim_partial),
        "nsk_ratio": pair(sim.sim_ratio, "name_skel"), "nsk_tset": pair(sim.sim_token_set, "name_skel"),
        "hn_sim": sim.sim_ratio(blank(F.col("hn_1")), blank(F.col("hn_2"))),
    }).drop("_cc_1", "_cc_2")


def with_core_address(records: DataFrame, stops: DataFrame) -> DataFrame:
    """addr_core: a record's address without its country's stop tokens, made once per record, before pairs are joined. The
    stop tokens of a country are one row; few tokens reach max(20, 0.2 %) of its records."""
    lists = small(stops.groupBy("country_n").agg(F.collect_list("token").alias("_stops")))
    none = F.array().cast("array<string>")
    core = F.array_join(F.filter(words(F.col("addr")), lambda t: ~F.array_contains(F.coalesce("_stops", none), t)), " ")
    return records.join(lists, "country_n", "left").withColumn("addr_core", core).drop("_stops")


def core_address(rows: DataFrame) -> DataFrame:
    """ad_core_tset on core addresses, and ad_core_empty."""
    empty = flag((F.col("addr_core_1") == "") | (F.col("addr_core_2") == ""))
    return rows.withColumns({"ad_core_tset": sim.sim_token_set(F.col("addr_core_1"), F.col("addr_core_2")), "ad_core_empty": empty})


def frequency_features(rows: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Counts of both names in the pool, and of the S1 name among all S1."""
    counts = name_counts(pool, "n_pool").join(name_counts(s1, "n_s1"), ["country_n", "name_core"], "full").na.fill(0)
    of = lambda n, **c: counts.select(F.col("country_n").alias(f"country_n_{n}"), F.col("name_core").alias(f"name_core_{n}"), *[F.col(k).alias(v) for k, v in c.items()])
    rows = rows.join(of(1, n_pool="s1_name_cnt", n_s1="s1_same_name"), ["country_n_1", "name_core_1"], "left").join(of(2, n_pool="c_name_cnt", n_s1="_n2"), ["country_n_2", "name_core_2"], "left")
    rows = rows.na.fill(0, ["s1_name_cnt", "s1_same_name", "c_name_cnt", "_n2"])
    return rows.withColumn("c_name_ratio", F.round(F.col("c_name_cnt") / F.greatest("_n2", F.lit(1)), 6)).drop("_n2")


def average_rank(value: str) -> Column:
    """Descending rank within an S1, ties averaged, null for null."""
    w = Window.partitionBy("s1_id").orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0)


def group_features(rows: DataFrame, gaps: tuple[str, ...] = ("bscore", "nc_tset", "ad_tset"), ranks: tuple[str, ...] = ("nf_tset", "ad_tset", "hn_sim", "ncc_ratio", "ad_core_tset")) -> DataFrame:
    """Size, gaps to the best, average ranks and votes over the candidates of an S1."""
    w = Window.partitionBy("s1_id")
    names = {"bscore": "bscore_gap_top", "ad_core_tset": "ad_core_rank"}
    rows = rows.withColumns({"n_cands": F.count("*").over(w), **{names.get(c, f"{c}_gap"): F.round(F.max(c).over(w) - F.col(c), 6) for c in gaps}, "n_hn_eq_s1": F.sum("hn_eq").over(w)})
    twin = F.max(F.when((F.col("hn_eq") == 1) & (F.col("nc_tset") >= 90), 1).otherwise(0)).over(w)
    rows = rows.withColumn("twin_better", flag((twin == 1) & (F.col("hn_eq") == 0) & (F.col("hn_both") == 1)))
    for c in ranks:
        rows = rows.withColumn(names.get(c, f"{c}_rank") if c == "ad_core_tset" else f"{c}_rank", average_rank(c))
    return rows


def anchors(rows: DataFrame, rank: str = "brank", most: int = 3) -> DataFrame:
    """An S1's first candidates, for comparison with its others."""
    return rows.filter(F.col(rank) <= most).select("s1_id", F.col("cand_id").alias("anchor_id"), F.col("name_core_2").alias("a_core"), F.col("addr_2").alias("a_addr"), F.col("hn_2").alias("a_hn"))


def anchor_votes(rows: DataFrame, rank: str = "brank") -> DataFrame:
    """s1_id, cand_id, n_anc_hn (other anchors with a house number, if this one has one), hn_vote (share of them with this
    one's; null without)."""
    both = rows.join(anchors(rows, rank), "s1_id").filter("anchor_id <> cand_id")
    n = F.count(F.when(F.col("hn_2").isNotNull(), F.col("a_hn")))
    same = F.count_if(F.col("a_hn") == F.col("hn_2"))
    return both.groupBy("s1_id", "cand_id").agg(n.alias("n_anc_hn"), F.when(n > 0, F.round(same / n, 6)).alias("hn_vote"))


def anchor_similarities(rows: DataFrame, rank: str = "brank") -> DataFrame:
    """Mean and largest token-set similarity of a candidate with the other anchors of its S1."""
    both = rows.select("s1_id", "cand_id", "name_core_2", "addr_2").join(anchors(rows, rank), "s1_id").filter("anchor_id <> cand_id")
    both = both.withColumns({"_n": sim.sim_token_set(F.col("name_core_2"), F.col("a_core")), "_a": sim.sim_token_set(F.col("addr_2"), F.col("a_addr"))})
    return both.groupBy("s1_id", "cand_id").agg(F.avg("_n").alias("anc_nc_mean"), F.max("_n").alias("anc_nc_max"), F.avg("_a").alias("anc_ad_mean"), F.max("_a").alias("anc_ad_max"))


def rerank_similarities(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Five cheap similarities of wide candidates."""
    rows = dealt(joined(pairs, s1, pool)).withColumns({"_1": compact(F.col("name_core_1")), "_2": compact(F.col("name_core_2")), "hn_1": house_number(F.col("addr_1")), "hn_2": house_number(F.col("addr_2"))})
    pair = lambda f, a: f(F.col(f"{a}_1"), F.col(f"{a}_2"))
    return rows.withColumns({"r_cc_ratio": sim.sim_ratio(F.col("_1"), F.col("_2")), "r_nf_part": pair(sim.sim_partial, "name_full"), "r_ad_tset": pair(sim.sim_token_set, "addr"), "r_nc_tset": pair(sim.sim_token_set, "name_core"), "r_hn_eq": (F.col("hn_1") == F.col("hn_2")).cast("int")}).drop("_1", "_2")


# The names of the matcher's 69 inputs, by kind.
FEATURES = (
    "bscore bscore_norm brank bname baddr bname_norm baddr_norm brank_name brank_addr rr rr_rank nf_ratio nf_tset nf_tsort nf_partial nf_jw "
    "nc_ratio nc_tset nc_jw nc_first_eq ncc_ratio ncc_partial nsk_ratio nsk_tset ad_ratio ad_tset ad_partial ad_core_tset ad_core_empty "
    "pc_eq pc_both num_jacc num_both hn_eq hn_both hn_sim hn_prefix init_pref legal_eq legal_conflict c_oov_frac "
    "len_name_s1 len_name_c len_addr_s1 len_addr_c addr_empty_any is_s3 same_country s1_name_cnt c_name_cnt s1_same_name c_name_ratio "
    "n_cands bscore_gap_top nc_tset_gap ad_tset_gap nf_tset_rank ad_tset_rank hn_sim_rank ncc_ratio_rank ad_core_rank n_hn_eq_s1 twin_better "
    "anc_nc_mean anc_nc_max anc_ad_mean anc_ad_max hn_vote n_anc_hn"
).split()


def build_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """s1_id, cand_id and FEATURES. Pairs without a re-ranker's rr and rr_rank take bscore_norm and brank for them."""
    if "rr" not in pairs.columns:
        pairs = pairs.withColumns({"rr": F.col("bscore_norm"), "rr_rank": F.col("brank")})
    stops = address_stop_tokens(s1)
    cored = with_core_address(s1, stops), with_core_address(pool, stops)
    base = settled(core_address(fuzzy_features(exact_features(dealt(joined(pairs, *cored))))), "pairs")
    rows = group_features(frequency_features(base, s1, pool)).join(unknown_share(pool, name_vocabulary(s1)).withColumnRenamed("entity_id", "cand_id"), "cand_id", "left")
    rows = rows.join(anchor_votes(base, "rr_rank"), ["s1_id", "cand_id"], "left").join(anchor_similarities(base, "rr_rank"), ["s1_id", "cand_id"], "left")
    return rows.select("s1_id", "cand_id", *FEATURES)
