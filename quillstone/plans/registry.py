"""Catalogue of the library's queries and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import similarity as sim
from quillstone.functions import text
from quillstone.operators import audit, boost, decide, groups, learn, metrics, pairs, rerank, retrieval
from quillstone.plans import oracles as o
from quillstone.sources.records import Linkage, id_lists, long_truth
from quillstone.sources.tables import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Context:
    """The linkage tables of a folder and what several queries derive from them. Normalised records, candidates
    and trained scores are written to the shared folder when first used, so a session that runs many queries derives them
    once and plans start from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = Linkage(spark, sf_dir)
        self.raw_s1, self.raw_pool, self.truth = t.s1, t.pool, t.truth
        self.raw = t.s1.unionAll(t.pool)
        # The sizes that the given SQL states; wide takes the reference's.
        self.p = retrieval.Retrieval(max_df=50, top_k=10, k_name=3, k_address=3)

    @cached_property
    def all(self) -> DataFrame:
        return settled(text.normalised(self.raw), "normalised")

    @property
    def s1(self) -> DataFrame:
        return self.all.filter("src = 'S1'")

    @property
    def pool(self) -> DataFrame:
        return self.all.filter("src <> 'S1'")

    @cached_property
    def weights(self) -> DataFrame:
        return retrieval.key_weights(retrieval.block_keys(self.pool), self.pool, self.p)

    @cached_property
    def scores(self) -> DataFrame:
        return retrieval.candidate_scores(retrieval.block_keys(self.s1), retrieval.block_keys(self.pool), self.weights)

    @cached_property
    def ranked(self) -> DataFrame:
        return retrieval.with_ranks(self.scores)

    @cached_property
    def candidates(self) -> DataFrame:
        return settled(retrieval.candidates(self.s1, self.pool, self.p), "candidates")

    @cached_property
    def wide(self) -> DataFrame:
        """Candidates of the reference's sizes, before the re-ranker."""
        return settled(retrieval.candidates(self.s1, self.pool, retrieval.Retrieval()), "wide")

    @cached_property
    def reranked(self) -> DataFrame:
        """Wide candidates with a trained score, of which the best are kept as the reference's final run does."""
        return rerank.reranked(self.s1, self.pool, self.truth, LEARNING("entity_id"))

    @cached_property
    def scored(self) -> DataFrame:
        """Candidates with a probability in closed form, and their labels."""
        p = F.round(0.02 + 0.96 * F.col("bscore_norm"), 6)
        return settled(metrics.labelled(self.candidates.select("s1_id", "cand_id", p.alias("p")), self.truth), "scored")

    @cached_property
    def counts(self) -> DataFrame:
        return settled(metrics.truth_counts(self.s1, self.truth), "counts")

    @cached_property
    def val(self) -> DataFrame:
        """S1 of the validation part: entity_id, country_n."""
        part = groups.block_split(groups.s1_blocks(self.s1, 20), 15, 300).filter("part = 'val'")
        return settled(self.s1.join(part, "entity_id", "left_semi").select("entity_id", "country_n"), "val")

    @property
    def labelled(self) -> DataFrame:
        """The validation part's countries but France, whose labels are taken as unknown."""
        return decide.labelled_countries(self.val.filter("country_n <> 'france'"))

    @property
    def tuned(self) -> DataFrame:
        """Countries that the given threshold holds for: all but France. The validation part may lack them, and is empty
        if no block is small enough."""
        return decide.labelled_countries(self.counts.filter("country_n <> 'france'"))

    @cached_property
    def selected(self) -> DataFrame:
        return settled(decide.apply_decision(self.scored, decide.Decision("threshold", 0.5, exclusive=True)), "selected")

    @property
    def joined(self) -> DataFrame:
        return pairs.joined(self.candidates, self.s1, self.pool)


# Models are trained on two thirds of the S1 records, picked by their number, and applied to all.
LEARNING = lambda column: F.substring(column, 4, 10).cast("long") % 3 != 0

CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    """One per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in CONTEXTS:
        CONTEXTS[key] = Context(spark, sf_dir)
    return CONTEXTS[key]


def query(sql: str | None = None):
    def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(context(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _over(cte: str, body: str) -> str:
    return f"WITH RECURSIVE {cte} {body}"


# Text rules.


def _column(name: str, expression, body: str, column: str) -> None:
    def f(c: Context) -> DataFrame:
        return c.all.select("entity_id", expression().alias(column))

    f.__name__ = name
    query(_over(o.NORM, f"SELECT entity_id, {body} AS {column} FROM norm"))(f)


_column("norm_name_full", lambda: F.col("name_full"), "name_full", "name_full")
_column("norm_name_core", lambda: F.col("name_core"), "name_core", "name_core")
_column("name_skeleton", lambda: F.col("name_skel"), "name_skel", "name_skel")
_column("addr_tokens_norm", lambda: F.col("addr"), "addr", "addr")
_column("postcode_extract", lambda: F.col("postcode"), "postcode", "postcode")
_column("addr_numbers", lambda: F.col("addr_nums"), "addr_nums", "addr_nums")
_column("house_number", lambda: text.house_number(F.col("addr")), r"nullif(regexp_extract(addr, '\b(\d+)', 1), '')", "hn")
_column("city_extract", lambda: text.city(F.col("business_address")), r"trim(regexp_replace(lower(coalesce(list_extract(string_split(business_address, ','), -2), '')), '\d', '', 'g'))", "city")
_column("name_initials", lambda: text.initials(F.col("name_core")), "array_to_string(list_transform(nt, lambda t: substr(t, 1, 1)), '')", "initials")
_column("compact_name", lambda: text.compact(F.col("name_core")), "replace(name_core, ' ', '')", "cc")
_column("unleet_tokens", lambda: F.array_join(F.transform(text.tokens(text.without_web(F.trim(text.to_ascii(F.col("business_name"))))), text.unleet), " "), "array_to_string(clear_tokens, ' ')", "tokens")
_column("join_initials", lambda: text.join_initials(F.array_join(F.transform(text.tokens(text.without_web(F.trim(text.to_ascii(F.col("business_name"))))), text.unleet), " ")), "array_to_string(joined_tokens, ' ')", "tokens")


@query()
def transliterated_names(c: Context) -> DataFrame:
    return c.raw.select("entity_id", text.to_ascii(F.col("business_name")).alias("ascii_name"))


LATIN, RENDERED = "abcdefghijklmnopqrstuvwxyz", "कखगघचछजझटठडढणतथदधनपफबभमयरल"
_EDGE = r"""^[.,;:!?()\[\]{}"''`\-/&|।॥]+|[.,;:!?()\[\]{}"''`\-/&|।॥]+$"""
_TOKENS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_INDIC = f""", ip AS (SELECT entity_id, translate(lower(business_name), '{LATIN}', '{RENDERED}') AS name FROM er_pool WHERE CAST(substr(entity_id, 4) AS BIGINT) % 3 = 0),
ap AS (SELECT {_TOKENS.format("p.name")} AS a, {_TOKENS.format("s.business_name")} AS b FROM ip p JOIN er_gt g ON g.match_id = p.entity_id JOIN er_s1 s ON s.entity_id = g.s1_id),
tl AS (SELECT regexp_replace(a[i], '{_EDGE}', '', 'g') AS token, regexp_replace(strip_accents(lower(b[i])), '[^a-z0-9]', '', 'g') AS latin FROM ap, unnest(range(1, len(a) + 1)) u(i) WHERE len(a) = len(b) AND regexp_matches(a[i], '[ऀ-෿]')),
tc AS (SELECT token, latin, count(*) AS n FROM tl WHERE token <> '' AND latin <> '' GROUP BY ALL),
dict AS (SELECT token, latin FROM (SELECT *, sum(n) OVER (PARTITION BY token) AS total, row_number() OVER (PARTITION BY token ORDER BY n DESC, latin) AS r FROM tc) WHERE r = 1 AND n >= 2 AND n >= 0.5 * total)"""


def _rendered(c: Context) -> DataFrame:
    """Every third pool record, its name in letters of an Indic script."""
    third = c.raw_pool.filter(F.substring("entity_id", 4, 10).cast("long") % 3 == 0)
    return third.withColumn("business_name", F.translate(F.lower("business_name"), LATIN, RENDERED))


@query(_over(o.TABLES + _INDIC, "SELECT token, latin FROM dict"))
def indic_dictionary(c: Context) -> DataFrame:
    return text.learned_dictionary(c.raw_s1, _rendered(c), c.truth)


@query(_over(o.TABLES + _INDIC + f", w AS (SELECT entity_id, i, t[i] AS word FROM (SELECT entity_id, {_TOKENS.format('name')} AS t FROM ip), unnest(range(1, len(t) + 1)) u(i))", f"SELECT entity_id, string_agg(coalesce(CASE WHEN regexp_matches(word, '[ऀ-෿]') THEN latin END, word), ' ' ORDER BY i) AS name FROM w LEFT JOIN dict ON token = regexp_replace(word, '{_EDGE}', '', 'g') GROUP BY entity_id"))
def latin_names(c: Context) -> DataFrame:
    rows = _rendered(c)
    return text.with_latin_names(rows, text.learned_dictionary(c.raw_s1, rows, c.truth)).select("entity_id", F.col("business_name").alias("name"))


@query(_over(o.NORM, "SELECT entity_id, name_full || ' | ' || addr AS text FROM norm"))
def scorer_texts(c: Context) -> DataFrame:
    return c.all.select("entity_id", text.scorer_text().alias("text"))


# Retrieval.


@query(_over(o.KEYS, "SELECT entity_id, ktype, kval, CAST(w AS DOUBLE) AS w, CAST(ch AS BIGINT) AS ch FROM allkeys"))
def block_keys(c: Context) -> DataFrame:
    return retrieval.block_keys(c.all).select("entity_id", "ktype", "kval", F.col("w").cast("double").alias("w"), F.col("ch").cast("long").alias("ch"))


@query(_over(o.INDEX, "SELECT country_n, ktype, kval, df FROM dfs"))
def key_df(c: Context) -> DataFrame:
    return retrieval.document_frequencies(retrieval.block_keys(c.pool))


@query(_over(o.INDEX, "SELECT country_n, ktype, kval, df, CAST(idf AS DOUBLE) AS idf FROM weights"))
def key_idf_pruned(c: Context) -> DataFrame:
    return c.weights.withColumn("idf", F.col("idf").cast("double"))


@query(_over(o.INDEX, "SELECT * FROM scores"))
def candidate_scores(c: Context) -> DataFrame:
    return c.scores


@query(_over(o.INDEX, "SELECT s1_id, cand_id, brank, brank_name, brank_addr FROM ranked"))
def candidate_channel_ranks(c: Context) -> DataFrame:
    return c.ranked.select("s1_id", "cand_id", "brank", "brank_name", "brank_addr")


@query(_over(o.CANDIDATES, "SELECT * FROM kept"))
def candidate_topk(c: Context) -> DataFrame:
    return retrieval.three_channel_top_k(c.ranked, c.p)


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, bscore_norm, bname_norm, baddr_norm FROM cands"))
def candidate_norm_scores(c: Context) -> DataFrame:
    return c.candidates.select("s1_id", "cand_id", "bscore_norm", "bname_norm", "baddr_norm")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, rr_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY bscore_norm DESC, cand_id) AS rr_rank FROM cands) WHERE rr_rank <= 8 AND (rr_rank <= 3 OR bscore_norm >= 0.4)"))
def adaptive_topk(c: Context) -> DataFrame:
    return retrieval.adaptive_top_k(c.candidates, "bscore_norm", 8, 3, 0.4).select("s1_id", "cand_id", "rr_rank")


@query(_over(o.CANDIDATES, "SELECT count(*) AS n_true, count(*) FILTER (brank <= 1) AS within_1, count(*) FILTER (brank <= 3) AS within_3, count(*) FILTER (brank <= 10) AS within_10, count(*) FILTER (brank <= 100000) AS within_100000 FROM truth LEFT JOIN ranked USING (s1_id, cand_id)"))
def missed_pair_ranks(c: Context) -> DataFrame:
    return retrieval.missed_ranks(c.ranked, c.truth, [1, 3, 10, 100000])


@query(_over(o.CANDIDATES, "SELECT CAST(kmin AS BIGINT) AS kmin, CAST(tau AS DOUBLE) AS tau, count(*) FILTER (r <= kmin OR bscore_norm >= tau) AS n_cands, count(*) FILTER ((r <= kmin OR bscore_norm >= tau) AND label = 1) AS n_true FROM (SELECT c.*, label, row_number() OVER (PARTITION BY s1_id ORDER BY bscore_norm DESC, cand_id) AS r FROM cands c LEFT JOIN truth USING (s1_id, cand_id)), (VALUES (1), (3), (5)) k(kmin), (VALUES (0.1), (0.3), (0.5)) t(tau) GROUP BY kmin, tau"))
def prune_sweep(c: Context) -> DataFrame:
    return retrieval.prune_sweep(c.candidates, "bscore_norm", [1, 3, 5], [0.1, 0.3, 0.5], c.truth)


@query(_over(o.CANDIDATES, "SELECT (SELECT count(*) FROM truth) AS n_true, (SELECT count(*) FROM truth JOIN cands USING (s1_id, cand_id)) AS n_found, (SELECT count(*) FROM cands) AS n_cands"))
def block_recall(c: Context) -> DataFrame:
    return retrieval.block_recall(c.candidates, c.truth)


@query()
def wide_candidates(c: Context) -> DataFrame:
    return c.wide


@query()
def wide_block_recall(c: Context) -> DataFrame:
    return retrieval.block_recall(c.wide, c.truth)


# Similarities: over the names of all candidates.
BEST = "best AS (SELECT s1_id, cand_id, {x} AS x, {y} AS y FROM pairs),"


def _similarity(name: str, f, field: str, body: str, cte: str = "") -> None:
    def run(c: Context) -> DataFrame:
        return c.joined.select("s1_id", "cand_id", F.round(f(F.col(f"{field}_1"), F.col(f"{field}_2")), 6).alias(name))

    run.__name__ = name
    query(_over(f"{o.CANDIDATES}, {cte}", body) if body else None)(run)


_similarity("sim_indel", sim.sim_ratio, "name_core", "SELECT b.s1_id, b.cand_id, round(CAST(ratio AS DOUBLE), 6) AS sim_indel FROM best b JOIN l USING (x, y)", BEST.format(x="c1", y="c2") + o.lcs_ratio("best"))
_SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda t: t <> '')), ' ')"
_similarity("sim_token_sort", sim.sim_token_sort, "name_full", "SELECT b.s1_id, b.cand_id, round(CAST(ratio AS DOUBLE), 6) AS sim_token_sort FROM best b JOIN l USING (x, y)", BEST.format(x=_SORTED.format("f1"), y=_SORTED.format("f2")) + o.lcs_ratio("best"))
_similarity("sim_jaro_winkler", sim.sim_jaro_winkler, "name_core", "SELECT s1_id, cand_id, round(jaro_winkler_similarity(x, y), 6) AS sim_jaro_winkler FROM best", BEST.format(x="c1", y="c2").rstrip(","))
_similarity("sim_token_set", sim.sim_token_set, "name_full", "")
_similarity("sim_partial", sim.sim_partial, "name_core", "")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, CASE WHEN u1 <> '' AND u2 <> '' THEN round(len(list_intersect(string_split(u1, ' '), string_split(u2, ' '))) / len(list_distinct(list_concat(string_split(u1, ' '), string_split(u2, ' ')))), 6) ELSE 0.0 END AS sim_jaccard FROM pairs"))
def sim_jaccard(c: Context) -> DataFrame:
    return c.joined.select("s1_id", "cand_id", F.round(sim.jaccard(text.words(F.col("addr_nums_1")), text.words(F.col("addr_nums_2"))), 6).alias("sim_jaccard"))


# Features.


@query(_over(o.NORM, "SELECT country_n, name_core, count(*) FILTER (src <> 'S1') AS n_pool, count(*) FILTER (src = 'S1') AS n_s1 FROM norm GROUP BY country_n, name_core"))
def name_counts(c: Context) -> DataFrame:
    return pairs.name_counts(c.pool, "n_pool").join(pairs.name_counts(c.s1, "n_s1"), ["country_n", "name_core"], "full").na.fill(0)


@query(_over(o.NORM, "SELECT country_n, token, df FROM (SELECT country_n, token, count(DISTINCT entity_id) AS df FROM norm, unnest(adt) u(token) WHERE src = 'S1' AND NOT regexp_matches(token, '[0-9]') GROUP BY ALL) JOIN (SELECT country_n, count(*) AS n FROM norm WHERE src = 'S1' GROUP BY country_n) USING (country_n) WHERE df >= greatest(20.0, 0.002 * n)"))
def addr_stop_tokens(c: Context) -> DataFrame:
    return pairs.address_stop_tokens(c.s1)


@query(_over(o.NORM, "SELECT DISTINCT country_n, token FROM norm, unnest(string_split(name_core, ' ')) u(token) WHERE src = 'S1' AND token <> ''"))
def name_vocab(c: Context) -> DataFrame:
    return pairs.name_vocabulary(c.s1)


@query(_over(o.NORM + ", v AS (SELECT DISTINCT country_n, token, 1 AS k FROM norm, unnest(string_split(name_core, ' ')) u(token) WHERE src = 'S1' AND token <> '')", "SELECT entity_id, round(count(*) FILTER (k IS NULL) / count(*), 6) AS c_oov_frac FROM (SELECT entity_id, country_n, token FROM norm, unnest(string_split(name_core, ' ')) u(token) WHERE src <> 'S1' AND token <> '') LEFT JOIN v USING (country_n, token) GROUP BY entity_id"))
def oov_fraction(c: Context) -> DataFrame:
    return pairs.unknown_share(c.pool, pairs.name_vocabulary(c.s1))


def _flag(e: str) -> str:
    return f"CAST(coalesce({e}, false) AS INT)"


@query(_over(o.CANDIDATES, f"SELECT s1_id, cand_id, {_flag("string_split(c1, ' ')[1] = string_split(c2, ' ')[1]")} AS nc_first_eq, {_flag("z1 = z2 AND z1 <> ''")} AS pc_eq, {_flag("z1 <> '' AND z2 <> ''")} AS pc_both, {_flag("u1 <> '' AND u2 <> ''")} AS num_both, length(f1) AS len_name_s1, length(f2) AS len_name_c, length(a1) AS len_addr_s1, length(a2) AS len_addr_c, {_flag("a1 = '' OR a2 = ''")} AS addr_empty_any, {_flag("src2 = 'S3'")} AS is_s3, {_flag("y1 = y2")} AS same_country FROM pairs"))
def pair_flags(c: Context) -> DataFrame:
    return pairs.exact_features(c.joined).select("s1_id", "cand_id", "nc_first_eq", "pc_eq", "pc_both", "num_both", "len_name_s1", "len_name_c", "len_addr_s1", "len_addr_c", "addr_empty_any", "is_s3", "same_country")


_LEGAL = "list_distinct(list_filter(string_split({}, ' '), lambda t: list_contains([" + o.LEGAL_SET + "], t)))"


@query(_over(o.CANDIDATES, f"SELECT s1_id, cand_id, {_flag('len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) = len(x) AND len(x) = len(y)')} AS legal_eq, {_flag('len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) = 0')} AS legal_conflict FROM (SELECT s1_id, cand_id, {_LEGAL.format('f1')} AS x, {_LEGAL.format('f2')} AS y FROM pairs)"))
def legal_agreement(c: Context) -> DataFrame:
    return pairs.exact_features(c.joined).select("s1_id", "cand_id", "legal_eq", "legal_conflict")


@query(_over(o.CANDIDATES, f"SELECT s1_id, cand_id, {_flag('h1 = h2')} AS hn_eq, {_flag('h1 IS NOT NULL AND h2 IS NOT NULL')} AS hn_both, {_flag('h1 <> h2 AND (starts_with(h1, h2) OR starts_with(h2, h1))')} AS hn_prefix FROM pairs"))
def house_number_relation(c: Context) -> DataFrame:
    return pairs.exact_features(c.joined).select("s1_id", "cand_id", "hn_eq", "hn_both", "hn_prefix")


@query(_over(o.CANDIDATES, f"SELECT s1_id, cand_id, {_flag('length(i) >= 2 AND length(i) < length(c1) AND starts_with(k, i)')} AS init_pref FROM (SELECT *, array_to_string(list_transform(list_filter(string_split(c1, ' '), lambda t: t <> ''), lambda t: substr(t, 1, 1)), '') AS i, replace(c2, ' ', '') AS k FROM pairs)"))
def initials_prefix(c: Context) -> DataFrame:
    return pairs.exact_features(c.joined).select("s1_id", "cand_id", "init_pref")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id) AS n_cands, round(max(bscore) OVER (PARTITION BY s1_id) - bscore, 6) AS bscore_gap_top FROM cands"))
def group_gaps(c: Context) -> DataFrame:
    rows = pairs.group_features(c.candidates.withColumns({"hn_eq": F.lit(0), "hn_both": F.lit(0), "nc_tset": F.lit(0.0)}), gaps=("bscore",), ranks=())
    return rows.select("s1_id", "cand_id", "n_cands", "bscore_gap_top")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, rank() OVER (PARTITION BY s1_id ORDER BY bname_norm DESC NULLS LAST) + (count(*) OVER (PARTITION BY s1_id, bname_norm) - 1) / 2.0 AS avg_rank FROM cands WHERE bname_norm IS NOT NULL"))
def group_average_ranks(c: Context) -> DataFrame:
    rows = c.candidates.withColumn("avg_rank", pairs.average_rank("bname_norm"))
    return rows.filter("avg_rank IS NOT NULL").select("s1_id", "cand_id", F.col("avg_rank").cast("double").alias("avg_rank"))


@query(_over(o.CANDIDATES, f"SELECT s1_id, cand_id, CAST(sum(e) OVER w AS BIGINT) AS n_hn_eq_s1, CAST(coalesce(max(CASE WHEN e = 1 AND z = 1 THEN 1 ELSE 0 END) OVER w = 1 AND e = 0 AND b = 1, false) AS INT) AS twin_better FROM (SELECT s1_id, cand_id, {_flag('h1 = h2')} AS e, {_flag('h1 IS NOT NULL AND h2 IS NOT NULL')} AS b, {_flag("z1 = z2 AND z1 <> ''")} AS z FROM pairs) WINDOW w AS (PARTITION BY s1_id)"))
def twin_better(c: Context) -> DataFrame:
    rows = pairs.exact_features(c.joined).withColumn("nc_tset", F.when(F.col("pc_eq") == 1, 100.0).otherwise(0.0))
    return pairs.group_features(rows, gaps=(), ranks=()).select("s1_id", "cand_id", "n_hn_eq_s1", "twin_better")


@query(_over(o.CANDIDATES, "SELECT a.s1_id, a.cand_id, count(b.h2) FILTER (a.h2 IS NOT NULL) AS n_anc_hn, round(count(*) FILTER (b.h2 = a.h2) / nullif(count(b.h2) FILTER (a.h2 IS NOT NULL), 0), 6) AS hn_vote FROM pairs a JOIN pairs b ON a.s1_id = b.s1_id AND b.brank <= 3 AND b.cand_id <> a.cand_id GROUP BY a.s1_id, a.cand_id"))
def anchor_votes(c: Context) -> DataFrame:
    return pairs.anchor_votes(pairs.exact_features(c.joined))


@query()
def pair_features_full(c: Context) -> DataFrame:
    return pairs.build_features(c.candidates, c.s1, c.pool)


@query()
def rerank_similarities(c: Context) -> DataFrame:
    return pairs.rerank_similarities(c.candidates, c.s1, c.pool).select("s1_id", "cand_id", "r_cc_ratio", "r_nf_part", "r_ad_tset", "r_nc_tset", "r_hn_eq")


_CITY = r"trim(regexp_replace(lower(coalesce(list_extract(string_split(business_address, ','), -2), '')), '\d', '', 'g'))"
_BLOCKS = f", b0 AS (SELECT entity_id, country_n, country_n || '|' || {_CITY} || '|' || substr(name_core, 1, 1) AS b1, country_n || '|' || {_CITY} || '|' || substr(name_core, 1, 3) AS b3 FROM norm WHERE src = 'S1'), blocks AS (SELECT entity_id, country_n, CASE WHEN count(*) OVER (PARTITION BY b1) > 20 THEN b3 ELSE b1 END AS block FROM b0)"


_SPLIT = _BLOCKS + ", z AS (SELECT block, count(*) AS n FROM blocks GROUP BY block HAVING count(*) <= 15), r AS (SELECT block, sum(n) OVER (ORDER BY md5(block), block ROWS UNBOUNDED PRECEDING) AS s FROM z), val AS (SELECT entity_id, country_n FROM blocks JOIN r USING (block) WHERE s <= 300)"


# Decisions and evaluation.


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, p FROM scored WHERE p >= 0.5"))
def decide_threshold(c: Context) -> DataFrame:
    return decide.threshold(c.scored, 0.5).select("s1_id", "cand_id", "p")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS r FROM scored) WHERE p >= 0.6 OR (r = 1 AND p >= 0.3)"))
def decide_top1(c: Context) -> DataFrame:
    return decide.threshold_or_best(c.scored, 0.6, 0.3).select("s1_id", "cand_id", "p")


@query(_over(o.CANDIDATES + """, e1 AS (SELECT s1_id, cand_id, p, row_number() OVER o AS m, CAST(sum(CAST(p AS DECIMAL(9,6))) OVER (o ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp, CAST(sum(CAST(p AS DECIMAL(9,6))) OVER w AS DOUBLE) AS k, CAST(sum(CAST(round(ln(greatest(1 - p, 1e-6)), 9) AS DECIMAL(18,9))) OVER w AS DOUBLE) AS lp FROM scored WHERE p >= 0.02 WINDOW w AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY p DESC, cand_id)),
e2 AS (SELECT *, round(1.25 * tp / (0.25 * (k + 0.1) + m), 9) AS f FROM e1), e3 AS (SELECT *, max(f) OVER (PARTITION BY s1_id) AS best FROM e2), e4 AS (SELECT s1_id, min(m) AS best_m FROM e3 WHERE f = best GROUP BY s1_id)""", "SELECT s1_id, cand_id, p FROM e3 JOIN e4 USING (s1_id) WHERE best > exp(lp - 0.1) AND m <= best_m"))
def decide_expected_f(c: Context) -> DataFrame:
    return decide.apply_decision(c.scored, decide.Decision("expected_f", 0.1)).select("s1_id", "cand_id", "p")


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, p FROM excl"))
def decide_exclusive(c: Context) -> DataFrame:
    return decide.exclusive(c.scored.filter("p >= 0.02")).select("s1_id", "cand_id", "p")


_MACRO = "count(*) AS n_s1, round(CAST(sum(CAST(f AS DECIMAL(18,9))) AS DOUBLE) / count(*), 6) AS f05, round(sum(tp) / greatest(sum(n_pred), 1), 6) AS precision, round(sum(tp) / greatest(sum(n_true), 1), 6) AS recall"


@query(_over(o.CANDIDATES, f"SELECT {_MACRO} FROM perone"))
def macro_f05(c: Context) -> DataFrame:
    return metrics.macro_f05(c.selected, c.counts)


@query(_over(o.CANDIDATES, f"SELECT country_n, {_MACRO} FROM perone GROUP BY country_n"))
def f05_by_country(c: Context) -> DataFrame:
    return metrics.macro_f05(c.selected, c.counts, "country_n")


@query(_over(o.CANDIDATES, "SELECT round(CAST(sum(CAST(CAST(f AS DECIMAL(18,9)) * w AS DECIMAL(28,13))) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 6) AS f05 FROM (SELECT f, CAST(CASE WHEN country_n = 'us' THEN 2 ELSE 1 END AS DECIMAL(9,4)) AS w FROM perone)"))
def weighted_f05(c: Context) -> DataFrame:
    return metrics.weighted_f05(c.selected, c.counts, F.when(F.col("country_n") == "us", 2).otherwise(1))


_GRID = """, grid AS (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(t)), both_rules AS (SELECT s1_id, p, label, false AS excl FROM scored UNION ALL SELECT s1_id, p, label, true FROM excl),
gp AS (SELECT excl, t, s1_id, count(*) AS n_pred, sum(label) AS tp FROM both_rules JOIN grid ON p >= t GROUP BY ALL),
gf AS (SELECT r.excl, t, c.s1_id, CASE WHEN n_true = 0 AND n_pred IS NULL THEN 1.0 WHEN n_pred IS NULL THEN 0.0 ELSE round(1.25 * tp / (0.25 * n_true + n_pred), 9) END AS f FROM (VALUES (false), (true)) r(excl), grid, counts c LEFT JOIN gp ON gp.s1_id = c.s1_id AND gp.t = grid.t AND gp.excl = r.excl),
gt AS (SELECT excl, t, round(CAST(sum(CAST(f AS DECIMAL(18,9))) AS DOUBLE) / count(*), 6) AS f05 FROM gf GROUP BY ALL)"""
_TS = [0.3, 0.4, 0.5, 0.6, 0.7]


@query(_over(o.CANDIDATES + _GRID.replace("gt.t", "t").replace("SELECT r.excl, t,", "SELECT r.excl, grid.t,"), "SELECT excl, t, f05 FROM gt"))
def tune_grid(c: Context) -> DataFrame:
    return decide.tune_grid(c.scored, c.counts, _TS)


@query(_over(o.CANDIDATES + _GRID.replace("SELECT r.excl, t,", "SELECT r.excl, grid.t,"), "SELECT excl, min(t) AS t, f05 FROM gt JOIN (SELECT excl, max(f05) AS f05 FROM gt GROUP BY excl) USING (excl, f05) GROUP BY excl, f05"))
def tuned_rules(c: Context) -> DataFrame:
    return decide.best_rules(decide.tune_grid(c.scored, c.counts, _TS))


_RULES = f""", ths AS (SELECT CAST(round(0.05 + 0.025 * i, 3) AS DOUBLE) AS t FROM range(0, 37) r(i)), t1s AS (SELECT CAST(v AS DOUBLE) AS t1 FROM (VALUES (0.2), (0.3), (0.4), (0.5), (0.6)) x(v)), als AS (SELECT CAST(v AS DOUBLE) AS a FROM (VALUES (0.0), (0.1), (0.25), (0.5), (1.0), (2.0)) x(v)),
bases AS (SELECT false AS excl, s1_id, cand_id, p, label FROM scored UNION ALL SELECT true, s1_id, cand_id, p, label FROM excl),
rk AS (SELECT *, row_number() OVER (PARTITION BY excl, s1_id ORDER BY p DESC, cand_id) AS r FROM bases),
f1 AS (SELECT excl, s1_id, label, p, r AS m, CAST(sum(CAST(p AS DECIMAL(9,6))) OVER (o ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp, CAST(sum(CAST(p AS DECIMAL(9,6))) OVER w AS DOUBLE) AS k, CAST(sum(CAST(round(ln(greatest(1 - p, 1e-6)), 9) AS DECIMAL(18,9))) OVER w AS DOUBLE) AS lp FROM rk WHERE p >= 0.02 WINDOW w AS (PARTITION BY excl, s1_id), o AS (PARTITION BY excl, s1_id ORDER BY r)),
f2 AS (SELECT f1.*, a, round(1.25 * tp / (0.25 * (k + a) + m), 9) AS f FROM f1, als), f3 AS (SELECT *, max(f) OVER (PARTITION BY excl, s1_id, a) AS best FROM f2), f4 AS (SELECT *, min(CASE WHEN f = best THEN m END) OVER (PARTITION BY excl, s1_id, a) AS best_m FROM f3),
ch AS (SELECT excl, 'threshold' AS mode, t, 1.0 AS t1, s1_id, label FROM rk JOIN ths ON p >= t UNION ALL SELECT excl, 'thr_top1', t, t1, s1_id, label FROM rk, ths, t1s WHERE t >= 0.5 AND t1 < t AND (p >= t OR (r = 1 AND p >= t1)) UNION ALL SELECT excl, 'expected_f', a, 1.0, s1_id, label FROM f4 WHERE best > exp(lp - a) AND m <= best_m),
pr AS (SELECT excl, mode, t, t1, s1_id, count(*) AS n_pred, sum(label) AS tp FROM ch GROUP BY ALL),
rules AS (SELECT excl, mode, t, CAST(t1 AS DOUBLE) AS t1, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp, round((CAST(sum(CAST(round(1.25 * tp / (0.25 * n_true + n_pred), 9) AS DECIMAL(18,9))) AS DOUBLE) + (SELECT count(*) FROM counts WHERE n_true = 0) - count(*) FILTER (n_true = 0)) / (SELECT count(*) FROM counts), 6) AS f05 FROM pr JOIN counts USING (s1_id) GROUP BY ALL)"""


@query(_over(o.CANDIDATES + _RULES, "SELECT * FROM rules"))
def tune_rules(c: Context) -> DataFrame:
    return decide.tune_rules(c.scored, c.counts)


@query(_over(o.CANDIDATES + _RULES, "SELECT mode, excl, t, t1, f05 FROM (SELECT *, row_number() OVER (PARTITION BY mode, excl ORDER BY f05 DESC, t, t1) AS rr FROM rules) WHERE rr = 1"))
def best_rules(c: Context) -> DataFrame:
    return decide.best_of_each_mode(decide.tune_rules(c.scored, c.counts))


@query(_over(o.NORM + _SPLIT, "SELECT DISTINCT country_n FROM val WHERE country_n <> 'france'"))
def labelled_countries(c: Context) -> DataFrame:
    return c.labelled


@query(_over(o.CANDIDATES + _SPLIT, "SELECT DISTINCT t.s1_id FROM truth t WHERE t.cand_id IN (SELECT cand_id FROM scored WHERE p >= 0.05 AND s1_id IN (SELECT entity_id FROM val)) AND t.s1_id NOT IN (SELECT entity_id FROM val)"))
def competitor_owners(c: Context) -> DataFrame:
    return groups.competitor_owners(c.scored, c.truth, c.val)


@query(_over(o.CANDIDATES + """, h AS (SELECT country_n, s1_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS r FROM excl JOIN counts USING (s1_id)), ns AS (SELECT country_n, count(*) AS n FROM counts GROUP BY country_n),
tg AS (SELECT sum(k) / sum(n) AS mk, 1 - sum(s) / sum(n) AS em FROM (SELECT country_n, count(*) AS k, count(*) FILTER (r = 1) AS s FROM h WHERE country_n <> 'france' AND p >= 0.5 GROUP BY country_n) JOIN ns USING (country_n)),
g AS (SELECT CAST(t AS DOUBLE) AS t, CAST(t1 AS DOUBLE) AS t1 FROM (SELECT round(0.5 + 0.005 * i, 3) AS t FROM range(0, 99) r(i)), (VALUES (1.0), (0.5), (0.6), (0.7), (0.8)) v(t1) WHERE t1 = 1.0 OR t1 < t),
tr AS (SELECT country_n, t, t1, count(*) AS k, count(*) FILTER (r = 1) AS s FROM h, g WHERE country_n = 'france' AND (p >= t OR (r = 1 AND p >= t1)) GROUP BY ALL),
d AS (SELECT country_n, t, t1, round(abs(k / n - mk) / mk + abs(1 - s / n - em) / greatest(em, 1e-3), 9) AS gap FROM tr JOIN ns USING (country_n), tg)""", "SELECT country_n, t, t1, gap FROM (SELECT *, row_number() OVER (PARTITION BY country_n ORDER BY gap, t, t1) AS q FROM d) WHERE q = 1"))
def prior_matched(c: Context) -> DataFrame:
    rows = decide.exclusive(c.scored.filter("p >= 0.02")).join(c.counts.select("s1_id", "country_n"), "s1_id")
    return decide.prior_matched(rows, c.s1, 0.5, c.tuned)


@query(_over(o.CANDIDATES + """, pc AS (SELECT country_n, s1_id, p FROM excl JOIN counts USING (s1_id)), ns AS (SELECT country_n, count(*) AS n FROM counts GROUP BY country_n),
ks AS (SELECT country_n, t, count(*) AS k FROM pc, (SELECT round(0.5 + 0.005 * i, 6) AS t FROM range(0, 99) r(i)) g WHERE p >= t GROUP BY ALL),
tg AS (SELECT sum(k) / sum(n) AS target FROM ks JOIN ns USING (country_n) WHERE country_n IN ('us', 'india') AND t = 0.5),
gap AS (SELECT country_n, t, round(abs(k / n - target), 9) AS d FROM ks JOIN ns USING (country_n), tg WHERE country_n NOT IN ('us', 'india'))""", "SELECT country_n, CAST(0.5 AS DOUBLE) AS t FROM ns WHERE country_n IN ('us', 'india') UNION ALL SELECT country_n, CAST(min(t) AS DOUBLE) FROM gap JOIN (SELECT country_n, min(d) AS d FROM gap GROUP BY country_n) USING (country_n, d) GROUP BY country_n"))
def shape_matched(c: Context) -> DataFrame:
    rows = decide.exclusive(c.scored.filter("p >= 0.02")).join(c.counts.select("s1_id", "country_n"), "s1_id")
    return decide.shape_matched(rows, c.s1, 0.5, c.tuned)


@query(_over(o.NORM + _BLOCKS, "SELECT * FROM blocks"))
def s1_blocks(c: Context) -> DataFrame:
    return groups.s1_blocks(c.s1, 20)


@query(_over(o.NORM + _BLOCKS + ", z AS (SELECT block, count(*) AS n FROM blocks GROUP BY block HAVING count(*) <= 15), r AS (SELECT block, sum(n) OVER (ORDER BY md5(block), block ROWS UNBOUNDED PRECEDING) AS s FROM z)", "SELECT entity_id, CASE WHEN s <= 300 THEN 'val' ELSE 'train' END AS part FROM blocks LEFT JOIN r USING (block)"))
def block_split(c: Context) -> DataFrame:
    return groups.block_split(groups.s1_blocks(c.s1, 20), 15, 300)


@query(_over(o.CANDIDATES, "SELECT * FROM counts"))
def truth_counts(c: Context) -> DataFrame:
    return c.counts


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, label FROM scored"))
def label_candidates(c: Context) -> DataFrame:
    return c.scored.select("s1_id", "cand_id", "label")


@query(_over(o.CANDIDATES, "SELECT CASE WHEN c.s1_id IS NULL THEN 'block_miss' WHEN label = 1 AND s.p IS NOT NULL THEN 'tp' WHEN label = 1 THEN 'model_fn' WHEN s.p IS NOT NULL THEN 'fp' ELSE 'tn' END AS bucket, count(*) AS n FROM (SELECT s1_id, cand_id FROM cands) c FULL JOIN truth t ON t.s1_id = c.s1_id AND t.cand_id = c.cand_id LEFT JOIN selected s ON s.s1_id = c.s1_id AND s.cand_id = c.cand_id GROUP BY 1".replace("label = 1 AND", "t.label = 1 AND").replace("WHEN label = 1 THEN", "WHEN t.label = 1 THEN")))
def loss_buckets(c: Context) -> DataFrame:
    return metrics.loss_buckets(c.candidates, c.selected, c.truth)


_CASES = ", cases AS (SELECT 'as_is' AS what, s1_id, label FROM selected UNION ALL SELECT 'no_fp', s1_id, label FROM selected WHERE label = 1 UNION ALL SELECT 'no_fn', s1_id, label FROM selected UNION ALL SELECT w, s1_id, label FROM (SELECT scored.* FROM scored ANTI JOIN selected USING (s1_id, cand_id) WHERE label = 1), (VALUES ('no_fn'), ('perfect_model')) v(w) UNION ALL SELECT 'perfect_model', s1_id, label FROM selected WHERE label = 1 UNION ALL SELECT 'perfect_blocking', s1_id, 1 FROM truth)"


@query(_over(o.CANDIDATES + _CASES, "SELECT what, round(CAST(sum(CAST(CASE WHEN n_true = 0 AND n IS NULL THEN 1.0 ELSE round(1.25 * coalesce(tp, 0) / greatest(0.25 * n_true + coalesce(n, 0), 1e-9), 9) END AS DECIMAL(18,9))) AS DOUBLE) / count(*), 6) AS f05 FROM (VALUES ('as_is'), ('no_fp'), ('no_fn'), ('perfect_model'), ('perfect_blocking')) v(what), counts LEFT JOIN (SELECT what, s1_id, count(*) AS n, sum(label) AS tp FROM cases GROUP BY ALL) x USING (what, s1_id) GROUP BY what".replace("FROM (VALUES ('as_is'), ('no_fp'), ('no_fn'), ('perfect_model'), ('perfect_blocking')) v(what), counts LEFT JOIN", "FROM (SELECT * FROM (VALUES ('as_is'), ('no_fp'), ('no_fn'), ('perfect_model'), ('perfect_blocking')) v(what), counts) LEFT JOIN")))
def loss_ablation(c: Context) -> DataFrame:
    return metrics.loss_ablation(c.scored, c.selected, c.counts, c.truth)


@query(_over(o.CANDIDATES + _SPLIT, "SELECT CASE WHEN t.s1_id IS NULL THEN 'distractor' WHEN v.entity_id IS NULL THEN 'non_val_s1' ELSE 'other_val_s1' END AS origin, count(*) AS n, round(CAST(sum(CAST(p AS DECIMAL(9,6))) AS DOUBLE) / count(*), 6) AS mean_p FROM selected s LEFT JOIN truth t ON t.cand_id = s.cand_id LEFT JOIN val v ON v.entity_id = t.s1_id WHERE s.label = 0 GROUP BY 1"))
def fp_origin(c: Context) -> DataFrame:
    return metrics.fp_origin(c.selected, c.truth, c.val)


@query(_over(o.CANDIDATES + ", bm AS (SELECT s1_id, count(*) AS n_bm FROM truth ANTI JOIN cands USING (s1_id, cand_id) GROUP BY s1_id)", "SELECT CASE WHEN n_true = 0 THEN 'singleton_fp' WHEN tp = 0 THEN 'no_tp' WHEN n_pred > tp THEN 'has_fp' WHEN coalesce(n_bm, 0) > 0 THEN 'block_miss_only' WHEN n_true > tp THEN 'model_fn_only' ELSE 'perfect' END AS category, count(*) AS n, round(CAST(sum(CAST(1 - f AS DECIMAL(18,9))) AS DOUBLE) / (SELECT count(*) FROM counts), 6) AS lost FROM perone LEFT JOIN bm USING (s1_id) GROUP BY 1"))
def s1_loss_categories(c: Context) -> DataFrame:
    return metrics.s1_categories(c.candidates, c.selected, c.counts, c.truth)


@query(_over(o.CANDIDATES, "SELECT country_n, CAST(k AS BIGINT) AS k, round(count(*) / max(n), 6) AS share FROM (SELECT country_n, least(coalesce(n_pred, 0), 7) AS k, count(*) OVER (PARTITION BY country_n) AS n FROM perone) GROUP BY country_n, k"))
def selection_histogram(c: Context) -> DataFrame:
    return metrics.match_numbers(c.selected, c.s1)


@query(_over(o.CANDIDATES, "SELECT country_n, round(count(*) FILTER (other > 0) / count(*), 6) AS changed, round(avg(coalesce(k_a, 0)), 6) AS k_a, round(avg(coalesce(k_b, 0)), 6) AS k_b FROM counts LEFT JOIN (SELECT s1_id, count(a) AS k_a, count(b) AS k_b, count(*) FILTER (a IS NULL OR b IS NULL) AS other FROM (SELECT s1_id, cand_id, 1 AS a FROM selected) FULL JOIN (SELECT s1_id, cand_id, 1 AS b FROM scored WHERE p >= 0.6) USING (s1_id, cand_id) GROUP BY s1_id) USING (s1_id) GROUP BY country_n"))
def selection_change(c: Context) -> DataFrame:
    return metrics.selection_change(c.selected, decide.threshold(c.scored, 0.6), c.s1)


@query(_over(o.CANDIDATES, "SELECT * FROM (SELECT s1_id, cand_id, round((CAST(sum(CAST(p AS DECIMAL(9,6))) AS DOUBLE) + 0.01 * (2 - count(*))) / 2, 9) AS p FROM (SELECT s1_id, cand_id, p FROM scored UNION ALL SELECT s1_id, cand_id, p FROM excl) GROUP BY s1_id, cand_id) WHERE p >= 0.02"))
def ensemble_avg(c: Context) -> DataFrame:
    return metrics.ensemble([c.scored, decide.exclusive(c.scored.filter("p >= 0.02"))])


@query(_over(o.CANDIDATES, "SELECT country_n, count(*) AS n_s1, round(avg(coalesce(k, 0)), 6) AS mean_k, round(count(*) FILTER (coalesce(k, 0) = 0) / count(*), 6) AS empty_share, round(coalesce(sum(k2), 0) / greatest(coalesce(sum(k), 0), 1), 6) AS s2_share FROM counts LEFT JOIN (SELECT s1_id, count(*) AS k, count(*) FILTER (cand_id LIKE 'S2-%') AS k2 FROM selected GROUP BY s1_id) USING (s1_id) GROUP BY country_n"))
def selection_shape(c: Context) -> DataFrame:
    return metrics.shape(c.selected, c.s1)


# Sources, outputs and checks.
_WIDE = ", wide AS (SELECT s1_id AS source1_entity_id, coalesce(string_agg(match_id, ',' ORDER BY match_id), '') AS ids FROM er_gt GROUP BY s1_id)"


@query(_over(o.TABLES, "SELECT DISTINCT s1_id, match_id FROM er_gt"))
def gt_long(c: Context) -> DataFrame:
    wide = c.truth.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_list("match_id")), ",").alias("matched_entity_ids"))
    return long_truth(wide)


@query(_over(o.CANDIDATES, "SELECT n.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY p DESC, cand_id), '') AS matched_entity_ids FROM er_s1 n LEFT JOIN selected s ON s.s1_id = n.entity_id GROUP BY n.entity_id"))
def matching_results(c: Context) -> DataFrame:
    return id_lists(c.raw_s1, c.selected, "matched_entity_ids")


@query(_over(o.CANDIDATES, "SELECT n.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY p DESC, cand_id), '') AS candidate_entity_ids FROM er_s1 n LEFT JOIN scored s ON s.s1_id = n.entity_id GROUP BY n.entity_id"))
def candidate_pairs(c: Context) -> DataFrame:
    return id_lists(c.raw_s1, c.scored, "candidate_entity_ids")


@query(_over(o.TABLES, """SELECT entity_id AS source1_entity_id, 'missing_s1' AS finding FROM er_s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 50 = 7 UNION ALL SELECT entity_id, 'repeated_id' FROM er_s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 50 = 11
UNION ALL SELECT entity_id, 's1_in_list' FROM er_s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 50 = 13 UNION ALL SELECT entity_id, 'wrong_prefix' FROM er_s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 50 = 17 UNION ALL SELECT entity_id, 'repeated_s1' FROM er_s1 WHERE CAST(substr(entity_id, 4) AS BIGINT) % 50 = 19"""))
def audit_findings(c: Context) -> DataFrame:
    """A list file with known faults at every fiftieth record."""
    n = F.substring("entity_id", 4, 10).cast("long") % 50
    ids = F.when(n == 11, "S2-1,S2-1").when(n == 13, "S1-1").when(n == 17, "X-1").otherwise("")
    lists = c.raw_s1.filter(n != 7).select(F.col("entity_id").alias("source1_entity_id"), ids.alias("matched_entity_ids"), n.alias("n"))
    lists = lists.unionAll(lists.filter("n = 19")).drop("n")
    return audit.audit_id_lists(lists, "matched_entity_ids", c.raw_s1)


_RATE = "round(avg(CAST(regexp_matches({c}, '{p}') AS INT)), 6) AS {k}"
_NOISE = ", ".join([*(_RATE.format(c="business_name", p=p, k=f"name_{k}") for k, p in audit.SCRIPTS.items()), *(_RATE.format(c="lower(business_name)", p=p, k=k) for k, p in audit.NAME_NOISE.items()), *(_RATE.format(c="business_address", p=p, k=k) for k, p in audit.ADDRESS_NOISE.items()), _RATE.format(c="business_address", p=audit.SCRIPTS["mojibake"], k="addr_mojibake"), _RATE.format(c="business_address", p=audit.SCRIPTS["devanagari"], k="addr_devanagari")])


@query(_over(o.TABLES, f"SELECT substr(entity_id, 1, 2) AS src, count(*) AS n, count(DISTINCT entity_id) AS n_ids, round(avg(CAST(business_name = '' AS INT)), 6) AS empty_name, round(avg(CAST(business_address = '' AS INT)), 6) AS empty_address, round(avg(length(business_name)), 6) AS mean_name, round(avg(length(business_address)), 6) AS mean_address, round(avg(CAST(regexp_matches(business_name, '[^\\x00-\\x7F]') AS INT)), 6) AS non_ascii_name FROM er_all GROUP BY 1"))
def profile_sources(c: Context) -> DataFrame:
    return audit.profile(c.raw)


@query(_over(o.TABLES, f"SELECT substr(entity_id, 1, 2) AS src, count(*) AS n, {_NOISE} FROM er_all GROUP BY 1"))
def noise_profile(c: Context) -> DataFrame:
    return audit.noise_profile(c.raw)


@query(_over(o.TABLES, "SELECT src, country, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, country) AS r FROM (SELECT substr(entity_id, 1, 2) AS src, country, count(*) AS n FROM er_all GROUP BY 1, 2)) WHERE r <= 10"))
def top_countries(c: Context) -> DataFrame:
    return audit.top_countries(c.raw)


@query(_over(o.TABLES + ", per AS (SELECT s1_id, count(match_id) AS k, count(*) FILTER (match_id LIKE 'S2-%') AS k2 FROM er_gt GROUP BY s1_id), o AS (SELECT list_sort(list(k)) AS ks, count(*) AS n FROM per)", "SELECT count(*) AS n_s1, round(count(*) FILTER (k = 0) / count(*), 6) AS singleton_share, round(avg(k), 6) AS mean_k, (SELECT ks[CAST(floor((n - 1) * 0.5 + 0.5) AS INT) + 1] FROM o) AS p50, (SELECT ks[CAST(floor((n - 1) * 0.9 + 0.5) AS INT) + 1] FROM o) AS p90, (SELECT ks[CAST(floor((n - 1) * 0.99 + 0.5) AS INT) + 1] FROM o) AS p99, max(k) AS max_k, round(sum(k2) / sum(k), 6) AS s2_share FROM per"))
def match_quantiles(c: Context) -> DataFrame:
    return audit.match_quantiles(c.truth)


@query(_over(o.TABLES + ", m AS (SELECT s1_id, substr(match_id, 1, 2) AS src, CAST(regexp_extract(s1_id, '(\\d+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(match_id, '(\\d+)$', 1) AS BIGINT) AS b FROM er_gt WHERE match_id IS NOT NULL), g AS (SELECT *, b - lag(b) OVER (PARTITION BY s1_id, src ORDER BY b) AS gap FROM m)", "SELECT src, count(*) AS n, round(corr(a, b), 4) AS id_corr, round(avg(CAST(a % 1000 = b % 1000 AS INT)), 6) AS same_last3, round(count(*) FILTER (gap = 1) / nullif(count(gap), 0), 6) AS gap_1 FROM g GROUP BY src"))
def leak_check(c: Context) -> DataFrame:
    return audit.leak_check(c.truth)


@query(_over(o.TABLES, """SELECT 'repeated_id' AS name, count(*) AS n_bad FROM (SELECT entity_id FROM er_all GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 's1_prefix', count(*) FROM er_s1 WHERE entity_id NOT LIKE 'S1-%' UNION ALL SELECT 'pool_prefix', count(*) FROM er_pool WHERE NOT regexp_matches(entity_id, '^S[23]-') UNION ALL SELECT 'truth_unknown_s1', count(DISTINCT s1_id) FROM er_gt WHERE s1_id NOT IN (SELECT entity_id FROM er_s1)
UNION ALL SELECT 'truth_unknown_match', count(DISTINCT match_id) FROM er_gt WHERE match_id NOT IN (SELECT entity_id FROM er_pool) UNION ALL SELECT 's1_without_truth', count(*) FROM er_s1 WHERE entity_id NOT IN (SELECT s1_id FROM er_gt) UNION ALL SELECT 'shared_match', count(*) FROM (SELECT match_id FROM er_gt WHERE match_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s1_id) > 1)"""))
def prep_invariants(c: Context) -> DataFrame:
    return audit.prep_invariants(c.raw_s1, c.raw_pool, c.truth)


@query(_over(o.CANDIDATES, "SELECT country_n, count(*) AS n_s1, round(avg(k), 6) AS matches_per_s1, round(avg(n), 6) AS cands_per_s1, round(count(*) FILTER (k = 0) / count(*), 6) AS empty_share, CAST(sum(k_out) AS BIGINT) AS n_outside, coalesce(max(n_shared), 0) AS n_shared FROM (SELECT country_n, s1_id, (SELECT count(*) FROM scored s WHERE s.s1_id = c.s1_id AND p >= 0.6) AS k, (SELECT count(*) FROM cands s WHERE s.s1_id = c.s1_id AND brank <= 5) AS n, (SELECT count(*) FROM (SELECT * FROM scored s WHERE p >= 0.6) s ANTI JOIN (SELECT * FROM cands WHERE brank <= 5) k USING (s1_id, cand_id) WHERE s.s1_id = c.s1_id) AS k_out FROM counts c) LEFT JOIN (SELECT country_n, count(*) AS n_shared FROM (SELECT country_n, cand_id FROM scored JOIN counts USING (s1_id) WHERE p >= 0.6 GROUP BY ALL HAVING count(*) > 1) GROUP BY country_n) USING (country_n) GROUP BY country_n"))
def submission_audit(c: Context) -> DataFrame:
    return audit.submission_audit(decide.threshold(c.scored, 0.6), c.candidates.filter("brank <= 5"), c.s1)


@query(_over(o.TABLES, "SELECT CAST(least(k, 10) AS BIGINT) AS k, count(*) AS n FROM (SELECT s1_id, count(match_id) AS k FROM er_gt GROUP BY s1_id) GROUP BY 1"))
def match_histogram(c: Context) -> DataFrame:
    return audit.match_histogram(c.truth)


@query(_over(o.TABLES, "SELECT match_id, count(DISTINCT s1_id) AS n_s1 FROM er_gt WHERE match_id IS NOT NULL GROUP BY match_id HAVING count(DISTINCT s1_id) > 1"))
def truth_exclusivity(c: Context) -> DataFrame:
    return audit.exclusivity(c.truth)


@query(_over(o.CANDIDATES, "SELECT source1_entity_id FROM (SELECT s1_id AS source1_entity_id FROM selected ANTI JOIN scored USING (s1_id, cand_id)) GROUP BY 1"))
def matches_not_candidates(c: Context) -> DataFrame:
    return audit.not_candidates(id_lists(c.raw_s1, c.selected, "matched_entity_ids"), id_lists(c.raw_s1, c.scored, "candidate_entity_ids"))


# Second stage.


def _context(c: Context) -> DataFrame:
    blocks = groups.s1_blocks(c.s1, 20).select(F.col("entity_id").alias("s1_id"), "block")
    return groups.stage2_context(c.scored.join(blocks, "s1_id").drop("label"))


@query(_over(o.CANDIDATES + _BLOCKS + """, d AS (SELECT s1_id, cand_id, p, block FROM scored JOIN blocks ON entity_id = s1_id WHERE p >= 0.05),
e AS (SELECT *, row_number() OVER o AS r_s1, max(p) OVER w AS p_max, CAST(sum(CAST(p AS DECIMAL(9,6))) OVER w AS DOUBLE) AS p_sum, count(*) FILTER (p > 0.5) OVER w AS n_hi, count(*) OVER w AS n_s1, round(p - coalesce(lead(p) OVER o, 0.0), 6) AS gap_next, count(*) OVER c AS c_n, row_number() OVER q AS c_rank, count(*) FILTER (p > 0.3) OVER c AS c_n_hi
  FROM d WINDOW w AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY p DESC, cand_id), c AS (PARTITION BY cand_id, block), q AS (PARTITION BY cand_id, block ORDER BY p DESC, s1_id))""",
"""SELECT e.*, round(e.p / e.p_max, 6) AS p_ratio, CASE WHEN e.c_n = 1 THEN 0.0 WHEN e.c_rank = 1 THEN c2.p ELSE c1.p END AS c_other, CASE WHEN e.r_s1 = 1 THEN s2.cand_id ELSE s1.cand_id END AS ref, coalesce(CASE WHEN e.r_s1 = 1 THEN s2.p ELSE s1.p END, 0.0) AS p_ref
FROM e LEFT JOIN e c1 ON c1.cand_id = e.cand_id AND c1.block = e.block AND c1.c_rank = 1 LEFT JOIN e c2 ON c2.cand_id = e.cand_id AND c2.block = e.block AND c2.c_rank = 2 LEFT JOIN e s1 ON s1.s1_id = e.s1_id AND s1.r_s1 = 1 LEFT JOIN e s2 ON s2.s1_id = e.s1_id AND s2.r_s1 = 2"""))
def stage2_context(c: Context) -> DataFrame:
    return _context(c)


@query()
def stage2_consistency(c: Context) -> DataFrame:
    return groups.stage2_consistency(_context(c), c.pool)


@query(_over(o.CANDIDATES, "SELECT s1_id, cand_id, CASE WHEN p >= 0.02 AND p < 0.995 AND label = 1 THEN round(p / 2 + 0.5, 8) ELSE p END AS p FROM scored"))
def band_overlay(c: Context) -> DataFrame:
    second = c.scored.filter("label = 1").select("s1_id", "cand_id", F.round(F.col("p") / 2 + 0.5, 8).alias("p2"))
    return groups.band_overlay(c.scored, second).select("s1_id", "cand_id", "p")


# Models.


def _learning(rows: DataFrame) -> DataFrame:
    return rows.filter(LEARNING("s1_id"))


@query()
def matcher_scores(c: Context) -> DataFrame:
    rows = settled(metrics.labelled(pairs.build_features(c.reranked.drop("label", *[f for f in learn.RERANK_FEATURES if f.startswith("r_")]), c.s1, c.pool), c.truth), "features")
    return boost.scored(boost.trained(rows, pairs.FEATURES, LEARNING("s1_id")), rows, pairs.FEATURES)


@query()
def reranker_scores(c: Context) -> DataFrame:
    return c.reranked.select("s1_id", "cand_id", "rr", "rr_rank")


@query()
def stack_scores(c: Context) -> DataFrame:
    shares = c.candidates.select("s1_id", "cand_id", F.coalesce("bname_norm", F.lit(0.0)).alias("a"), F.coalesce("baddr_norm", F.lit(0.0)).alias("b"))
    rows = settled(metrics.labelled(shares, c.truth), "shares")
    return learn.stacked(learn.train_stacker(_learning(rows), ["a", "b"]), rows, ["a", "b"]).select("s1_id", "cand_id", "p")


def _blocks(c: Context) -> DataFrame:
    return groups.s1_blocks(c.s1, 20)


@query()
def stage2_scores(c: Context) -> DataFrame:
    rows = _context(c).join(groups.stage2_consistency(_context(c), c.pool), ["s1_id", "cand_id"])
    rows = settled(metrics.labelled(rows, c.truth), "stage2")
    return learn.rescored(rows, folds=3)[0].select("s1_id", "cand_id", "label", "p2")


def name_overlap(a: list[str], b: list[str]) -> list[float]:
    """A second scorer that needs no weights: the Jaccard share of words."""
    return [len(x & y) / max(1, len(x | y)) for x, y in ((set(s.split()), set(t.split())) for s, t in zip(a, b, strict=True))]


def _second(c: Context) -> DataFrame:
    return learn.second_scores(learn.band_texts(c.scored, c.s1, c.pool), name_overlap)


@query(_over(o.CANDIDATES, "SELECT c.s1_id, c.cand_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS ce FROM (SELECT s1_id, cand_id, list_filter(string_split(f1 || ' | ' || a1, ' '), lambda t: t <> '') AS x, list_filter(string_split(f2 || ' | ' || a2, ' '), lambda t: t <> '') AS y FROM pairs) c JOIN scored USING (s1_id, cand_id) WHERE p >= 0.02 AND p < 0.995"))
def second_scores(c: Context) -> DataFrame:
    return _second(c).withColumn("ce", F.round("ce", 6))


@query(_over(o.CANDIDATES, """, every AS (SELECT s1_id, cand_id, p, round(max(p) OVER w - p, 6) AS p_gap, count(*) FILTER (p >= 0.5) OVER w AS s1_nhi FROM scored WINDOW w AS (PARTITION BY s1_id)), band AS (SELECT e.*, bname_norm AS ce FROM every e JOIN cands USING (s1_id, cand_id) WHERE p >= 0.02 AND p < 0.995 AND bname_norm IS NOT NULL)
SELECT s1_id, cand_id, round(ln(p / (1 - p)), 6) AS lp, ce, p_gap, rank() OVER (PARTITION BY s1_id ORDER BY ce DESC) + (count(*) OVER (PARTITION BY s1_id, ce) - 1) / 2.0 AS ce_rank, round(max(ce) OVER (PARTITION BY s1_id) - ce, 6) AS ce_gap, count(*) OVER (PARTITION BY s1_id) AS n_band, s1_nhi FROM band""").replace(")} , every", "), every").replace(" , every", ", every"))
def scorer_context(c: Context) -> DataFrame:
    second = c.candidates.filter("bname_norm IS NOT NULL").select("s1_id", "cand_id", F.col("bname_norm").alias("ce"))
    return groups.scorer_context(c.scored, second).select("s1_id", "cand_id", "lp", "ce", "p_gap", "ce_rank", "ce_gap", "n_band", "s1_nhi")


@query()
def restacked_scores(c: Context) -> DataFrame:
    return learn.restacked(c.scored, _second(c), _blocks(c), folds=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
