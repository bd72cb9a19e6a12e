"""DuckDB SQL of the library's queries: common table expressions over the same tables, independent of the engine's code."""

from __future__ import annotations

from quillstone.functions.maps import ADDRESS, LEGAL, LOOK_ALIKE, NAME_STOP, REGION_PHRASES, REGIONS
from quillstone.sources.records import BASE_SQL, POOL_SQL, S1_SQL, TRUTH_SQL


def _sql(template: str) -> str:
    for name, value in {"string": "VARCHAR", "customer": "customer", "part": "part", "base": "er_base"}.items():
        template = template.replace("{" + name + "}", value)
    return template


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(token: str, values: dict[str, str]) -> str:
    """A token's value in a map literal, or the token."""
    keys, held = (", ".join(map(_text, x)) for x in (values.keys(), values.values()))
    return f"coalesce(list_extract([{held}], list_position([{keys}], {token})), {token})"


def _unleet(token: str) -> str:
    inner = token
    for digit, letter in LOOK_ALIKE.items():
        for _ in range(2):  # once more for digits whose letter the match before has taken
            inner = f"regexp_replace({inner}, '(^|[a-z]){digit}([a-z])', '\\1{letter}\\2', 'g')"
    return f"CASE WHEN length(regexp_replace({token}, '[^a-z]', '', 'g')) >= 3 AND regexp_matches({token}, '[0-9]') THEN {inner} ELSE {token} END"


SKELETON = "name_core"
for _find, _put in (("ph", "f"), ("([kgcjtdbsr])h", "\\1"), ("w", "v"), ("[qc]", "k"), ("z", "j"), ("x", "ks"), ("[aeiouy]", "")):
    SKELETON = f"regexp_replace({SKELETON}, '{_find}', '{_put}', 'g')"
# Runs of a character: RE2 has no back-references, so characters that equal the one before are left out.
SKELETON = f"(SELECT string_agg(CASE WHEN i = 1 OR substr(q, CAST(i AS INT), 1) <> substr(q, CAST(i - 1 AS INT), 1) THEN substr(q, CAST(i AS INT), 1) ELSE '' END, '' ORDER BY i) FROM (SELECT {SKELETON} AS q), unnest(range(1, length(q) + 1)) AS u(i))"
PHRASES = "regexp_replace(regexp_replace(strip_accents(lower(business_address)), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
for _find, _put in REGION_PHRASES.items():
    PHRASES = f"regexp_replace({PHRASES}, '\\b{_find}\\b', '{_put}', 'g')"
STOPS = ", ".join(_text(x) for x in sorted(set(LEGAL.values()) | set(NAME_STOP)))
LEGAL_SET = ", ".join(_text(x) for x in sorted(set(LEGAL.values())))

TABLES = f"""er_base AS ({_sql(BASE_SQL)}), er_s1 AS ({_sql(S1_SQL)}), er_pool AS ({_sql(POOL_SQL)}), er_gt AS ({_sql(TRUTH_SQL)}),
er_all AS (SELECT * FROM er_s1 UNION ALL SELECT * FROM er_pool)"""

NORM = rf"""{TABLES},
t1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(business_name))), '^(?:https?://)?(?:www\.)?@?', ''), '\.(?:com|net|org|in|co|fr|io|biz|info|us)(?:\.[a-z]{{2}})?$', ''), '[\s\-#:]*\d{{6,}}$', '') AS q FROM er_all),
t2 AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(replace(replace(q, '&', ' and '), '@', ' at '), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS raw_tokens FROM t1),
t3 AS (SELECT *, list_transform(raw_tokens, lambda t: {_unleet("t")}) AS clear_tokens FROM t2),
t4 AS (SELECT *, ' ' || array_to_string(clear_tokens, '  ') || ' ' AS spaced FROM t3),
t5 AS (SELECT *, list_filter(string_split(replace(replace(replace(regexp_replace(spaced, ' ([a-z]) ', ' <\1> ', 'g'), '>  <', ''), '<', ''), '>', ''), ' '), lambda x: x <> '') AS joined_tokens FROM t4),
t6 AS (SELECT *, list_transform(joined_tokens, lambda t: {_map("t", LEGAL)}) AS full_tokens FROM t5),
t7 AS (SELECT *, array_to_string(full_tokens, ' ') AS name_full, array_to_string(list_filter(full_tokens, lambda t: NOT list_contains([{STOPS}], t)), ' ') AS short_name,
  list_filter(string_split({PHRASES}, ' '), lambda x: x <> '') AS a0 FROM t6),
t8 AS (SELECT *, CASE WHEN short_name = '' THEN name_full ELSE short_name END AS name_core,
  list_filter(list_transform(list_transform(list_transform(a0, lambda t: {_map("t", REGIONS)}), lambda t: {_map("t", ADDRESS)}), lambda t: regexp_replace(regexp_replace(t, '^(\d+)(?:st|nd|rd|th)$', '\1'), '^0+([0-9])', '\1')), lambda x: x <> '') AS addr_tokens FROM t7),
norm AS (SELECT entity_id, business_name, business_address, name_full, name_core, coalesce(trim(regexp_replace({SKELETON}, '\s+', ' ', 'g')), '') AS name_skel, array_to_string(addr_tokens, ' ') AS addr,
  coalesce(list_extract(regexp_extract_all(lower(business_address), '\b[1-9]\d{{5}}\b'), -1), list_extract(list_filter(regexp_extract_all(lower(business_address), '\b\d{{5}}\b'), lambda x: substr(x, 1, 2) <> '00'), -1), '') AS postcode,
  array_to_string(list_sort(list_distinct(regexp_extract_all(array_to_string(addr_tokens, ' '), '\d+'))), ' ') AS addr_nums,
  lower(trim(country)) AS country_n, substr(entity_id, 1, 2) AS src, list_filter(string_split(name_core, ' '), lambda x: x <> '') AS nt, addr_tokens AS adt, raw_tokens, clear_tokens, joined_tokens FROM t8)"""

KEYS = rf"""{NORM},
allkeys AS (
  SELECT entity_id, country_n, 'n' AS ktype, v AS kval, 1.0 AS w, 0 AS ch FROM norm, unnest(nt) u(v) WHERE length(v) >= 2
  UNION SELECT entity_id, country_n, 'b', nt[i] || ' ' || nt[i + 1], 1.0, 0 FROM norm, unnest(range(1, len(nt))) u(i)
  UNION SELECT entity_id, country_n, 'p', substr(v, 1, 4), 0.5, 0 FROM norm, unnest(nt) u(v) WHERE length(v) >= 5
  UNION SELECT entity_id, country_n, 'a', v, 0.4, 1 FROM norm, unnest(adt) u(v) WHERE length(v) >= 3
  UNION SELECT entity_id, country_n, 'z', postcode, 1.5, 1 FROM norm WHERE postcode <> ''
  UNION SELECT entity_id, country_n, 'c', adt[i] || ' ' || adt[i + 1], 0.8, 1 FROM norm, unnest(range(1, len(adt))) u(i)
  UNION SELECT entity_id, country_n, 'x', nt[1] || ' ' || v, 1.0, 1 FROM norm, unnest(adt) u(v) WHERE regexp_matches(v, '^[0-9]+[a-z]?$') AND len(nt) > 0
  UNION SELECT entity_id, country_n, 'k', substr(replace(name_core, ' ', ''), 1, 8), 0.8, 0 FROM norm WHERE length(replace(name_core, ' ', '')) >= 6
  UNION SELECT entity_id, country_n, 'e', replace(name_core, ' ', ''), 1.5, 0 FROM norm WHERE replace(name_core, ' ', '') <> ''
  UNION SELECT entity_id, country_n, 's', v, 0.5, 0 FROM norm, unnest(string_split(name_skel, ' ')) u(v) WHERE length(v) >= 3),
s1keys AS (SELECT * FROM allkeys WHERE entity_id LIKE 'S1-%'), poolkeys AS (SELECT * FROM allkeys WHERE entity_id NOT LIKE 'S1-%')"""

INDEX = f"""{KEYS},
sizes AS (SELECT country_n, count(*) AS n FROM norm WHERE src <> 'S1' GROUP BY country_n),
dfs AS (SELECT country_n, ktype, kval, count(*) AS df FROM poolkeys GROUP BY ALL),
weights AS (SELECT country_n, ktype, kval, df, CAST(round(ln(CAST(n + 1 AS DOUBLE)) - ln(CAST(df + 1 AS DOUBLE)), 9) AS DECIMAL(18,9)) AS idf FROM dfs JOIN sizes USING (country_n) WHERE df <= 50),
own AS (SELECT entity_id AS s1_id, country_n, ktype, kval, ch, CAST(CAST(w AS DECIMAL(3,1)) * idf AS DECIMAL(20,10)) AS x FROM s1keys JOIN weights USING (country_n, ktype, kval)),
scores AS (SELECT s1_id, p.entity_id AS cand_id, CAST(sum(x) AS DOUBLE) AS bscore, CAST(sum(CASE WHEN own.ch = 0 THEN x ELSE 0 END) AS DOUBLE) AS bname, CAST(sum(CASE WHEN own.ch = 1 THEN x ELSE 0 END) AS DOUBLE) AS baddr
  FROM own JOIN poolkeys p USING (country_n, ktype, kval) GROUP BY s1_id, p.entity_id),
maxima AS (SELECT s1_id, CAST(sum(x) AS DOUBLE) AS qmax, CAST(sum(CASE WHEN own.ch = 0 THEN x ELSE 0 END) AS DOUBLE) AS qmax_n, CAST(sum(CASE WHEN own.ch = 1 THEN x ELSE 0 END) AS DOUBLE) AS qmax_a FROM own GROUP BY s1_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY bscore DESC, cand_id) AS brank,
  CASE WHEN bname > 0 THEN row_number() OVER (PARTITION BY s1_id ORDER BY bname DESC, cand_id) END AS brank_name, CASE WHEN baddr > 0 THEN row_number() OVER (PARTITION BY s1_id ORDER BY baddr DESC, cand_id) END AS brank_addr FROM scores)"""

CANDIDATES = f"""{INDEX},
rest AS (SELECT s1_id, cand_id, bname, baddr, row_number() OVER (PARTITION BY s1_id, bname > 0 ORDER BY bname DESC, cand_id) AS rn, row_number() OVER (PARTITION BY s1_id, baddr > 0 ORDER BY baddr DESC, cand_id) AS ra FROM ranked WHERE brank > 10),
kept AS (SELECT r.* FROM ranked r LEFT JOIN rest x USING (s1_id, cand_id) WHERE r.brank <= 10 OR (x.bname > 0 AND x.rn <= 3) OR (x.baddr > 0 AND x.ra <= 3)),
cands AS (SELECT k.*, round(bscore / nullif(qmax, 0), 6) AS bscore_norm, round(bname / nullif(qmax_n, 0), 6) AS bname_norm, round(baddr / nullif(qmax_a, 0), 6) AS baddr_norm FROM kept k JOIN maxima USING (s1_id)),
truth AS (SELECT DISTINCT s1_id, match_id AS cand_id, 1 AS label FROM er_gt WHERE match_id IS NOT NULL),
counts AS (SELECT n.entity_id AS s1_id, n.country_n, count(g.match_id) AS n_true FROM norm n LEFT JOIN er_gt g ON g.s1_id = n.entity_id WHERE n.src = 'S1' GROUP BY ALL),
scored AS (SELECT s1_id, cand_id, round(0.02 + 0.96 * bscore_norm, 6) AS p, coalesce(label, 0) AS label FROM cands LEFT JOIN truth USING (s1_id, cand_id)),
excl AS (SELECT s1_id, cand_id, p, label FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) AS r FROM scored WHERE p >= 0.02) WHERE r = 1),
selected AS (SELECT * FROM excl WHERE p >= 0.5),
perone AS (SELECT c.*, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, CASE WHEN n_true = 0 AND coalesce(n_pred, 0) = 0 THEN 1.0 ELSE round(1.25 * coalesce(tp, 0) / greatest(0.25 * n_true + coalesce(n_pred, 0), 1e-9), 9) END AS f
  FROM counts c LEFT JOIN (SELECT s1_id, count(*) AS n_pred, CAST(sum(label) AS BIGINT) AS tp FROM selected GROUP BY s1_id) USING (s1_id)),
hn AS (SELECT entity_id, nullif(regexp_extract(addr, '\\b(\\d+)', 1), '') AS hn FROM norm),
pairs AS (SELECT c.s1_id, c.cand_id, c.brank, c.bscore, a.name_full AS f1, b.name_full AS f2, a.name_core AS c1, b.name_core AS c2, a.addr AS a1, b.addr AS a2, a.postcode AS z1, b.postcode AS z2, a.addr_nums AS u1, b.addr_nums AS u2, a.country_n AS y1, b.country_n AS y2, b.src AS src2, h.hn AS h1, g.hn AS h2
  FROM cands c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.cand_id JOIN hn h ON h.entity_id = c.s1_id JOIN hn g ON g.entity_id = c.cand_id)"""


def lcs_ratio(pairs: str) -> str:
    """SQL of s1_id, cand_id, ratio over a relation with texts x and y: the length of the longest common subsequence, a
    row of its table at a time."""
    return f"""
u AS (SELECT DISTINCT x, y FROM {pairs}),
g AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS r FROM u
  UNION ALL SELECT x, y, i + 1, list_transform(range(0, length(y) + 1), lambda j: CAST(list_max(list_prepend(r[CAST(j + 1 AS INT)], list_transform(list_filter(range(1, j + 1), lambda k: substr(y, CAST(k AS INT), 1) = substr(x, CAST(i + 1 AS INT), 1)), lambda k: r[CAST(k AS INT)] + 1))) AS INT)) FROM g WHERE i < length(x)),
l AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * r[len(r)] / (length(x) + length(y)) END AS ratio FROM g WHERE i = length(x))"""
