"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quillstone-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def settled(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written once as Parquet and read back: plans that build on it start there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(held: DataFrame) -> None:
    """Deletes the files of a settled table that nothing will read again."""
    jvm = held.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in held.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(held.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df written, counted, and marked for broadcast if it has that many rows at most; else it is joined by shuffling."""
    held = settled(df, "small")
    return F.broadcast(held) if held.count() <= rows else held
