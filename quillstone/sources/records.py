"""Record sources and sinks: tab-separated tables, ground truth, id lists, and the derived linkage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header: no quoting, all strings, empty is null, further fields of long lines dropped."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=schema, mode="PERMISSIVE", nullValue="")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A record table; null name, address and country become empty."""
    return read_tsv(spark, path, COLUMNS).na.fill("", COLUMNS[1:])


def long_truth(wide: DataFrame) -> DataFrame:
    """source1_entity_id, matched_entity_ids (comma-joined) -> s1_id, match_id; a null match for an empty list."""
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return wide.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("m")).select("s1_id", F.nullif("m", F.lit("")).alias("match_id")).distinct()


def id_lists(all_s1: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Every S1 with its comma-joined candidates, best first; empty where it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), "cand_id"))), lambda x: x["cand_id"]), ",").alias(column))
    return all_s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_id_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated, never quoted, with a header, in ascending S1 order; a range-sorted file set."""
    a, b = lists.columns
    lists.orderBy(a).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


BASE_SQL = """
SELECT c.c_custkey AS k, p1.p_name || ' ' || p2.p_name AS stem, lower(c.c_mktsegment) AS seg, CAST(c.c_custkey % 5 AS INT) AS form,
  100 + (c.c_custkey * 37) % 9000 AS hn, p3.p_name AS street, CAST(c.c_custkey % 4 AS INT) AS way,
  'city' || substr('abcdefghijklmnopqrstuvwxyz', CAST(c.c_nationkey AS INT) + 1, 1) AS city,
  CAST(10000 + (c.c_custkey * 7919) % 89999 AS {string}) AS pc,
  CASE CAST(c.c_custkey % 3 AS INT) WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM {customer} c CROSS JOIN (SELECT count(*) AS n FROM {part}) z
JOIN {part} p1 ON p1.p_partkey = (c.c_custkey * 7) % z.n
JOIN {part} p2 ON p2.p_partkey = (c.c_custkey * 13 + 5) % z.n
JOIN {part} p3 ON p3.p_partkey = (c.c_custkey * 11 + 3) % z.n"""
S1_SQL = """
SELECT 'S1-' || lpad(CAST(k AS {string}), 7, '0') AS entity_id,
  stem || ' ' || seg || CASE form WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Inc.' WHEN 3 THEN ' SARL' ELSE '' END AS business_name,
  CAST(hn AS {string}) || ' ' || street || CASE way WHEN 0 THEN ' Road' WHEN 1 THEN ' Street' WHEN 2 THEN ' Avenue' ELSE ' Boulevard' END || ', ' || city || ', ' || pc AS business_address,
  country FROM {base}"""
POOL_SQL = """
SELECT 'S2-' || lpad(CAST(k AS {string}), 7, '0') AS entity_id,
  CASE CAST(k % 6 AS INT) WHEN 0 THEN upper(stem || ' ' || seg) WHEN 1 THEN stem || ' ' || seg || ' Pvt. Ltd.' WHEN 2 THEN replace(stem, 'a', '4') || ' ' || seg
    WHEN 3 THEN seg || ' ' || stem WHEN 4 THEN 'www.' || replace(stem, ' ', '') || '.com' ELSE stem || ' ' || seg || ' services' END AS business_name,
  CASE CAST(k % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN substr(CAST(hn AS {string}), 1, 2) || ' ' || street || ', ' || city WHEN 2 THEN city || ', ' || CAST(hn AS {string}) || ' ' || street || ', ' || pc
    ELSE CAST(hn AS {string}) || ' ' || street || CASE way WHEN 0 THEN ' rd' WHEN 1 THEN ' st' WHEN 2 THEN ' av.' ELSE ' blvd' END || ', ' || city || ', ' || pc END AS business_address,
  country FROM {base} WHERE k % 20 <> 0
UNION ALL SELECT 'S3-' || lpad(CAST(k AS {string}), 7, '0'), stem || ' & ' || seg, '00' || CAST(hn AS {string}) || ', ' || street || ', ' || city, country FROM {base} WHERE k % 20 <> 0 AND k % 3 <> 1
UNION ALL SELECT 'S2-' || lpad(CAST(k + 5000000 AS {string}), 7, '0'), stem || ' ' || seg, CAST(hn + 1 AS {string}) || ' ' || street || ' st, ' || city || ', ' || pc, country FROM {base} WHERE k % 5 = 0"""
TRUTH_SQL = """
SELECT 'S1-' || lpad(CAST(k AS {string}), 7, '0') AS s1_id, 'S2-' || lpad(CAST(k AS {string}), 7, '0') AS match_id FROM {base} WHERE k % 20 <> 0
UNION ALL SELECT 'S1-' || lpad(CAST(k AS {string}), 7, '0'), 'S3-' || lpad(CAST(k AS {string}), 7, '0') FROM {base} WHERE k % 20 <> 0 AND k % 3 <> 1
UNION ALL SELECT 'S1-' || lpad(CAST(k AS {string}), 7, '0'), CAST(NULL AS {string}) FROM {base} WHERE k % 20 = 0"""


class Linkage:
    """The linkage tables that are derived from the customer and part tables of a folder: s1, pool, truth.

    The one-row count of parts is the only thing joined without a key.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part")}
        sql = lambda q, **t: spark.sql(q.replace("{string}", "STRING"), **t)
        base = sql(BASE_SQL, **tables)
        self.s1 = sql(S1_SQL, base=base)
        self.pool = sql(POOL_SQL, base=base)
        self.truth = sql(TRUTH_SQL, base=base)
