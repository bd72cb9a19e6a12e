"""The opN_ queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import new_path, table


TOXIC_SCORE = 0.7


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.secrets import SecretScan, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"), SecretScan(vocabulary("byte_bpe_50k.tiktoken")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.toxicity import Toxicity, fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = score(docs, fit(docs.filter(~held_out), labels.filter(~held_out), Toxicity()))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"), "n_windows")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.packing import Packing, pack

    return pack(table(spark, sf_dir, "documents"), Packing(vocabulary("byte_bpe_50k.json")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.htmltext import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.langid import LanguageId, fit, predict

    docs, p = table(spark, sf_dir, "documents"), LanguageId()
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = predict(docs, fit(docs.filter(~held_out), p), p)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.kneser import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.tokenfiles import read_tokens, with_checksums, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return with_checksums(read_tokens(spark, path))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM benchmark),
w AS (SELECT item_id, least(len(t), 10) AS n, array_to_string(t[i:i + least(len(t), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS u(i) WHERE len(t) > 0),
m AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, i, m.n, array_to_string(t[i:i + m.n - 1], ' ') AS k FROM d, m, unnest(range(1, len(t) - m.n + 2)) AS u(i) WHERE len(t) >= m.n),
f AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON p.k = w.k AND p.n = w.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM f), unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(t[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(t) - 33)) AS u(i) WHERE len(t) >= 35),
r AS (SELECT w.doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT DISTINCT doc_id, j FROM r, unnest(range(i, i + 35)) AS u(j)),
x AS (SELECT doc_id, j, t[j] AS word FROM d, unnest(range(1, len(t) + 1)) AS u(j)),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j WHERE g.j IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(t[i:i + 2], ' ')) AS k FROM d, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS u(i) WHERE len(t) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, s.k, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.k) AS o FROM s JOIN (SELECT k, count(*) AS c FROM s GROUP BY k) f USING (k)),
x AS (SELECT r.doc_id, r.k FROM r JOIN n USING (doc_id) WHERE o <= n - CAST(ceil(0.85 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b AND sb.k = sa.k JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
  GROUP BY c.a, c.b, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
p AS (SELECT doc_id AS a, doc_id AS m FROM d UNION SELECT e.b, p.m FROM p JOIN e ON e.a = p.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.m AS component_id, d.doc_id = q.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(m) AS m FROM p GROUP BY a) q ON q.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op7_decontamination": OP7_SQL, "op9_minhash": OP9_SQL}
