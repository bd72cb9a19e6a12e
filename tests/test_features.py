"""All 69 features of sf0.001's candidates against plain Python, group by group."""

import math

import pytest

from quillstone.functions import similarity as sim
from quillstone.operators import pairs, retrieval
from quillstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark):
    c = registry.context(spark, SF)
    rows = {(r.s1_id, r.cand_id): r.asDict() for r in pairs.build_features(c.candidates, c.s1, c.pool).collect()}
    s1, pool = ({r.entity_id: r for r in df.collect()} for df in (c.s1, c.pool))
    return rows, s1, pool, {(r.s1_id, r.cand_id): r for r in c.candidates.collect()}


def groups(rows):
    out = {}
    for (a, b), r in rows.items():
        out.setdefault(a, {})[b] = r
    return out


def house(address):
    return next((w[: len(w) - len(w.lstrip("0123456789"))] for w in address.split() if w[0].isdigit()), None)


def average_rank(value, values):
    return sum(v > value for v in values) + (sum(v == value for v in values) + 1) / 2


def test_all_features_are_there(held):
    rows, *_, candidates = held
    assert rows.keys() == candidates.keys() and all(set(pairs.FEATURES) <= r.keys() for r in rows.values()) and len(set(pairs.FEATURES)) == 69


def test_similarities(held):
    rows, s1, pool, _ = held
    scorers = {"ratio": sim.ratio, "tset": sim.token_set, "tsort": sim.token_sort, "partial": sim.partial, "jw": sim.jaro_winkler}
    fields = {"nf": "name_full", "nc": "name_core", "nsk": "name_skel", "ad": "addr"}
    seen = {}
    for (a, b), r in list(rows.items())[::7]:
        for f in ("nf_ratio", "nf_tset", "nf_tsort", "nf_partial", "nf_jw", "nc_ratio", "nc_tset", "nc_jw", "nsk_ratio", "nsk_tset", "ad_ratio", "ad_tset", "ad_partial"):
            field, scorer = f.split("_")
            x, y = s1[a][fields[field]], pool[b][fields[field]]
            if (scorer, x, y) not in seen:
                seen[scorer, x, y] = scorers[scorer](x, y)
            assert math.isclose(r[f], seen[scorer, x, y], abs_tol=1e-4), (f, x, y)
        x, y = s1[a].name_core.replace(" ", ""), pool[b].name_core.replace(" ", "")
        assert math.isclose(r["ncc_ratio"], sim.ratio(x, y), abs_tol=1e-4) and math.isclose(r["ncc_partial"], sim.partial(x, y), abs_tol=1e-4)
        assert math.isclose(r["hn_sim"], sim.ratio(house(s1[a].addr) or "", house(pool[b].addr) or ""), abs_tol=1e-4)


def test_counts_and_vocabulary(held):
    rows, s1, pool, _ = held
    vocabulary = {(r.country_n, t) for r in s1.values() for t in r.name_core.split()}
    names = lambda table: {k: sum((x.country_n, x.name_core) == k for x in table.values()) for k in {(x.country_n, x.name_core) for x in table.values()}}
    in_pool, in_s1 = names(pool), names(s1)
    for (a, b), r in rows.items():
        x, y = s1[a], pool[b]
        tokens = y.name_core.split()
        assert math.isclose(r["c_oov_frac"], sum((y.country_n, t) not in vocabulary for t in tokens) / len(tokens), abs_tol=1e-5) if tokens else r["c_oov_frac"] is None
        assert (r["s1_name_cnt"], r["c_name_cnt"], r["s1_same_name"]) == (in_pool.get((x.country_n, x.name_core), 0), in_pool[y.country_n, y.name_core], in_s1[x.country_n, x.name_core])
        assert math.isclose(r["c_name_ratio"], r["c_name_cnt"] / max(1, in_s1.get((y.country_n, y.name_core), 0)), abs_tol=1e-5)


def test_groups(held):
    rows, *_ = held
    for group in groups(rows).values():
        every = list(group.values())
        twin = any(r["hn_eq"] == 1 and r["nc_tset"] >= 90 for r in every)
        for r in every:
            assert (r["n_cands"], r["n_hn_eq_s1"]) == (len(every), sum(x["hn_eq"] for x in every))
            assert r["twin_better"] == int(twin and r["hn_eq"] == 0 and r["hn_both"] == 1)
            for c, gap in (("bscore", "bscore_gap_top"), ("nc_tset", "nc_tset_gap"), ("ad_tset", "ad_tset_gap")):
                assert math.isclose(r[gap], max(x[c] for x in every) - r[c], abs_tol=1e-5)
            for c, rank in (("nf_tset", "nf_tset_rank"), ("ad_tset", "ad_tset_rank"), ("hn_sim", "hn_sim_rank"), ("ncc_ratio", "ncc_ratio_rank"), ("ad_core_tset", "ad_core_rank")):
                assert float(r[rank]) == average_rank(r[c], [x[c] for x in every]), rank


def test_anchors(held):
    rows, _, pool, _ = held
    for group in groups(rows).values():
        anchors = [b for b, r in group.items() if r["rr_rank"] <= 3]
        for b, r in group.items():
            others = [pool[x] for x in anchors if x != b]
            if not others:
                assert r["anc_nc_mean"] is None and r["n_anc_hn"] is None
                continue
            names = [sim.token_set(pool[b].name_core, x.name_core) for x in others]
            places = [sim.token_set(pool[b].addr, x.addr) for x in others]
            own = house(pool[b].addr)
            votes = [house(x.addr) == own for x in others if own is not None and house(x.addr) is not None]
            for f, want in (("anc_nc_mean", sum(names) / len(names)), ("anc_nc_max", max(names)), ("anc_ad_mean", sum(places) / len(places)), ("anc_ad_max", max(places))):
                assert math.isclose(r[f], want, abs_tol=1e-4), f
            assert r["n_anc_hn"] == len(votes)
            assert r["hn_vote"] is None if not votes else math.isclose(r["hn_vote"], sum(votes) / len(votes), abs_tol=1e-5)


def test_consistency_and_rerank(spark, held):
    c = registry.context(spark, SF)
    _, s1, pool, _ = held
    context = registry.queries()["stage2_context"](spark, SF).collect()
    ref = {(r.s1_id, r.cand_id): r.ref for r in context}
    for r in registry.queries()["stage2_consistency"](spark, SF).collect():
        other = ref[r.s1_id, r.cand_id]
        x, y = pool[r.cand_id], pool.get(other)
        want = [-1.0] * 4 if other is None else [sim.ratio(x.name_core, y.name_core), sim.token_set(x.name_core, y.name_core), sim.token_set(x.addr, y.addr), sim.token_sort(x.name_full, y.name_full)]
        assert all(math.isclose(g, w, abs_tol=1e-4) for g, w in zip((r.ref_nc_ratio, r.ref_nc_tset, r.ref_ad_tset, r.ref_nf_tsort), want, strict=True))
    for r in pairs.rerank_similarities(c.candidates, c.s1, c.pool).limit(300).collect():
        x, y = s1[r.s1_id], pool[r.cand_id]
        h1, h2 = house(x.addr), house(y.addr)
        assert math.isclose(r.r_cc_ratio, sim.ratio(x.name_core.replace(" ", ""), y.name_core.replace(" ", "")), abs_tol=1e-4)
        assert math.isclose(r.r_nf_part, sim.partial(x.name_full, y.name_full), abs_tol=1e-4) and math.isclose(r.r_ad_tset, sim.token_set(x.addr, y.addr), abs_tol=1e-4)
        assert r.r_hn_eq == (None if h1 is None or h2 is None else int(h1 == h2))


def test_key_bound_is_the_only_loss(spark):
    """Every pair that shares a kept key is scored."""
    c = registry.context(spark, SF)
    keys = {}
    for r in retrieval.block_keys(c.all).collect():
        keys.setdefault(r.entity_id, set()).add((r.country_n, r.ktype, r.kval))
    df = {}
    for e, own in keys.items():
        if not e.startswith("S1"):
            for k in own:
                df[k] = df.get(k, 0) + 1
    kept = {e: {k for k in own if df.get(k, 0) <= 50 and k in df} for e, own in keys.items()}
    want = {(a, b) for a in kept if a.startswith("S1") for b in kept if not b.startswith("S1") and kept[a] & kept[b]}
    assert {(r.s1_id, r.cand_id) for r in c.scores.collect()} == want
