"""Candidate retrieval: blocking keys, their inverted index with IDF weights, and the three-channel top-k.

The country is part of every join key, so there is no loop over countries and each stays apart. Keys that more than
max_df pool records of a country share are dropped, which bounds the fan-out of a key in the query join; a long posting
list is split by AQE. Sums run over decimals, so they do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.maps import KEY_TYPES
from quillstone.functions.text import compact, words
from quillstone.sources.tables import small


@dataclass(frozen=True)
class Retrieval:
    """top_k, k_name, k_address: candidates kept by the whole score, and further ones by each channel.

    The defaults are the reference's sizes before its re-ranker, with the max_df of its final run."""

    max_df: int = 600
    top_k: int = 300
    k_name: int = 60
    k_address: int = 60


def _struct(kind: str, value: Column) -> Column:
    w, ch = KEY_TYPES[kind]
    return F.struct(F.lit(kind).alias("ktype"), value.alias("kval"), F.lit(w).cast("decimal(3,1)").alias("w"), F.lit(ch).alias("ch"))


def _pairs(t: Column) -> Column:
    return F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def block_keys(records: DataFrame) -> DataFrame:
    """Normalised records -> entity_id, country_n, ktype, kval, w, ch; distinct within a record, without a shuffle."""
    split = records.select("entity_id", "country_n", "postcode", words(F.col("name_core")).alias("n"), words(F.col("addr")).alias("a"), words(F.col("name_skel")).alias("s"), compact(F.col("name_core")).alias("cc"))
    of = lambda kind, values: F.transform(values, lambda v: _struct(kind, v))
    one = lambda kind, value, when: F.when(when, F.array(_struct(kind, value))).otherwise(F.array().cast("array<struct<ktype:string,kval:string,w:decimal(3,1),ch:int>>"))
    first = F.try_element_at("n", F.lit(1))
    keys = F.concat(
        of("n", F.filter("n", lambda t: F.length(t) >= 2)),
        of("b", _pairs(F.col("n"))),
        of("p", F.transform(F.filter("n", lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 4))),
        of("a", F.filter("a", lambda t: F.length(t) >= 3)),
        one("z", F.col("postcode"), F.col("postcode") != ""),
        of("c", _pairs(F.col("a"))),
        of("x", F.transform(F.filter("a", lambda t: t.rlike("^[0-9]+[a-z]?$") & first.isNotNull()), lambda t: F.concat_ws(" ", first, t))),
        one("k", F.substring("cc", 1, 8), F.length("cc") >= 6),
        one("e", F.col("cc"), F.col("cc") != ""),
        of("s", F.filter("s", lambda t: F.length(t) >= 3)),
    )
    return split.select("entity_id", "country_n", F.inline(F.array_distinct(keys)))


KEY = ["country_n", "ktype", "kval"]


def document_frequencies(pool_keys: DataFrame) -> DataFrame:
    return pool_keys.groupBy(*KEY).agg(F.count("*").alias("df"))


def key_weights(pool_keys: DataFrame, pool: DataFrame, p: Retrieval) -> DataFrame:
    """KEY, df, idf of the keys that at most max_df records share; a country's size is one row, broadcast if there are
    few."""
    sizes = small(pool.groupBy("country_n").agg(F.count("*").alias("n")))
    idf = F.round(F.log((F.col("n") + 1).cast("double")) - F.log((F.col("df") + 1).cast("double")), 9).cast("decimal(18,9)")
    return document_frequencies(pool_keys).filter(F.col("df") <= p.max_df).join(sizes, "country_n").select(*KEY, "df", idf.alias("idf"))


def candidate_scores(s1_keys: DataFrame, pool_keys: DataFrame, weights: DataFrame) -> DataFrame:
    """s1_id, cand_id, bscore, bname, baddr: sums of the S1 side's weights times the IDF over shared keys. Posting lists of
    at most max_df records go to each S1 as they are and are only spread there; sums run over whole numbers of 1e-10."""
    x = (F.col("w") * F.col("idf")).cast("decimal(20,10)")
    own = s1_keys.join(weights, KEY).select(F.col("entity_id").alias("s1_id"), *KEY, "ch", (x * F.lit(10**10).cast("decimal(11,0)")).cast("long").alias("x"))
    postings = pool_keys.join(weights.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.collect_list("entity_id").alias("ids"))
    lists = own.join(postings, KEY).select("s1_id", "ch", "x", "ids").repartition("s1_id")
    hits = lists.select("s1_id", "ch", "x", F.explode("ids").alias("cand_id"))
    total = lambda c: F.sum(c).cast("double") / 1e10
    channel = lambda c: total(F.when(F.col("ch") == c, F.col("x")).otherwise(0))
    return hits.groupBy("s1_id", "cand_id").agg(total(F.col("x")).alias("bscore"), channel(0).alias("bname"), channel(1).alias("baddr"))


def query_maxima(s1_keys: DataFrame, weights: DataFrame) -> DataFrame:
    """s1_id, qmax, qmax_n, qmax_a: the scores of a candidate with all of the S1's kept keys."""
    x = (F.col("w") * F.col("idf")).cast("decimal(20,10)")
    channel = lambda c: F.sum(F.when(F.col("ch") == c, x).otherwise(F.lit(0).cast("decimal(20,10)"))).cast("double")
    return s1_keys.join(weights, KEY).groupBy(F.col("entity_id").alias("s1_id")).agg(F.sum(x).cast("double").alias("qmax"), channel(0).alias("qmax_n"), channel(1).alias("qmax_a"))


def _rank(order: Column, *more: Column) -> Column:
    return F.row_number().over(Window.partitionBy("s1_id").orderBy(order, *more)).cast("long")


def with_ranks(scores: DataFrame) -> DataFrame:
    """brank over all candidates, brank_name and brank_addr where that channel's score is positive; ties by cand_id."""
    channel = lambda c: F.when(F.col(c) > 0, _rank(F.col(c).desc(), F.col("cand_id")))
    return scores.withColumns({"brank": _rank(F.col("bscore").desc(), F.col("cand_id")), "brank_name": channel("bname"), "brank_addr": channel("baddr")})


def three_channel_top_k(ranked: DataFrame, p: Retrieval) -> DataFrame:
    """The best by the whole score, and among the rest the best by either channel."""
    rest = F.when(F.col("brank") <= p.top_k, 1).otherwise(0)
    rank = lambda c: F.row_number().over(Window.partitionBy("s1_id", F.when((rest == 0) & (F.col(c) > 0), 1).otherwise(0)).orderBy(F.col(c).desc(), F.col("cand_id")))
    keep = ranked.withColumns({"rn": rank("bname"), "ra": rank("baddr")})
    extra = lambda c, r, k: (F.col("brank") > p.top_k) & (F.col(c) > 0) & (F.col(r) <= k)
    return keep.filter((F.col("brank") <= p.top_k) | extra("bname", "rn", p.k_name) | extra("baddr", "ra", p.k_address)).drop("rn", "ra")


def with_normalised_scores(candidates: DataFrame, maxima: DataFrame) -> DataFrame:
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    joined = candidates.join(maxima, "s1_id")
    return joined.withColumns({"bscore_norm": share("bscore", "qmax"), "bname_norm": share("bname", "qmax_n"), "baddr_norm": share("baddr", "qmax_a")}).drop("qmax", "qmax_n", "qmax_a")


def candidates(s1: DataFrame, pool: DataFrame, p: Retrieval | None = None) -> DataFrame:
    """Normalised records -> candidates of every S1 with scores, ranks and normalised scores."""
    p = p or Retrieval()
    s1_keys, pool_keys = block_keys(s1), block_keys(pool)
    weights = key_weights(pool_keys, pool, p)
    kept = three_channel_top_k(with_ranks(candidate_scores(s1_keys, pool_keys, weights)), p)
    return with_normalised_scores(kept, query_maxima(s1_keys, weights))


def adaptive_top_k(scored: DataFrame, score: str, keep: int, least: int, tau: float) -> DataFrame:
    """Candidates with rr_rank up to `least`, and up to `keep` with a score of tau or more."""
    ranked = scored.withColumn("rr_rank", _rank(F.col(score).desc(), F.col("cand_id")))
    return ranked.filter((F.col("rr_rank") <= keep) & ((F.col("rr_rank") <= least) | (F.col(score) >= tau)))


def prune_sweep(scored: DataFrame, score: str, least: list[int], taus: list[float], truth: DataFrame) -> DataFrame:
    """For each (kmin, tau) of a small grid: candidates kept and true pairs kept. One pass: rows are expanded by the grid."""
    ranked = scored.withColumn("r", _rank(F.col(score).desc(), F.col("cand_id")))
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("hit"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("kmin"), F.lit(t).alias("tau")) for k in least for t in taus])).alias("g")
    rows = ranked.join(true, ["s1_id", "cand_id"], "left").select("r", score, "hit", grid).select("*", "g.kmin", "g.tau")
    kept = (F.col("r") <= F.col("kmin")) | (F.col(score) >= F.col("tau"))
    return rows.groupBy("kmin", "tau").agg(F.count_if(kept).alias("n_cands"), F.count_if(kept & F.col("hit").isNotNull()).alias("n_true"))


def block_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """n_true, n_found, n_cands over all S1."""
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"))
    found = true.join(pairs.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi").agg(F.count("*").alias("n_found"))
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(true, "n_true").join(found, F.lit(True)).join(one(pairs, "n_cands"), F.lit(True))


def missed_ranks(ranked: DataFrame, truth: DataFrame, within: list[int]) -> DataFrame:
    """How many true pairs have brank up to each k; one row."""
    true = truth.filter("match_id IS NOT NULL").select("s1_id", F.col("match_id").alias("cand_id"))
    joined = true.join(ranked.select("s1_id", "cand_id", "brank"), ["s1_id", "cand_id"], "left")
    return joined.agg(F.count("*").alias("n_true"), *[F.count_if(F.col("brank") <= k).alias(f"within_{k}") for k in within])
