"""What a run leaves behind: spilled tables, its record, and the archive of its results."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.records import id_lists, write_id_lists


def index_name(split: str, country: str, rules: int, keys: int, max_df: int) -> str:
    """Folder of a stored index: another version of the rules, the keys or the bound gets another folder."""
    return f"{split}_{country}_{rules}_{keys}_{max_df}"


def write_features(features: DataFrame, path: str, by: str = "country_n") -> None:
    """Labelled or test features, kept for later models; a folder per country, so one is read or replaced alone."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_predictions(scored: DataFrame, path: str, floor: float = 0.02) -> None:
    """All candidates' ids, and the scores of the pairs with p >= floor."""
    scored.select("s1_id", "cand_id", "brank").write.mode("overwrite").parquet(f"{path}/candidates")
    scored.filter(F.col("p") >= floor).write.mode("overwrite").parquet(f"{path}/scored")


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/candidates"), spark.read.parquet(f"{path}/scored")


def write_results(all_s1: DataFrame, matches: DataFrame, candidates: DataFrame, path: str) -> None:
    """Both list files, as tables of tab-separated parts."""
    write_id_lists(id_lists(all_s1, matches, "matched_entity_ids"), f"{path}/matching_results")
    write_id_lists(id_lists(all_s1, candidates, "candidate_entity_ids"), f"{path}/candidate_pairs")


def record_run(spark: SparkSession, path: str, run: str, **metrics: object) -> None:
    """Append one run's metrics; a later row of the same run adds to the earlier."""
    row = [(run, k, json.dumps(v)) for k, v in sorted(metrics.items())]
    spark.createDataFrame(row, "run string, metric string, value string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """run, metric, value (JSON): the latest of each."""
    return spark.read.parquet(path).groupBy("run", "metric").agg(F.max_by("value", "at").alias("value"))


def leaderboard(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """run, score: runs by a numeric metric, best first."""
    rows = run_metrics(spark, path).filter(F.col("metric") == metric)
    return rows.select("run", F.col("value").cast("double").alias("score")).orderBy(F.col("score").desc(), "run")


def archive(tables: dict[str, DataFrame], files: list[str], out: str) -> None:
    """A zip of tab-separated tables, with headers, and of local files. Rows stream through the driver a partition at a time,
    as one archive is one file; it is written where the driver runs."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
        for name, df in tables.items():
            with held.open(name, "w") as file:
                file.write(("\t".join(df.columns) + "\n").encode())
                for row in df.toLocalIterator():
                    file.write(("\t".join("" if v is None else str(v) for v in row) + "\n").encode())
        for path in files:
            held.write(path, Path(path).name)
