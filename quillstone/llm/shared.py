"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


#: Folders of stored tables; what no operator has dropped goes when the application ends in an orderly way.
KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, **options))


def store(df: DataFrame, name: str, **options) -> str:
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not KEPT:
        atexit.register(drop_kept)
    KEPT.add(path)
    return path


def drop_kept() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(KEPT) if spark is not None else ():
        with suppress(Exception):  # the folder may be gone with its file system
            drop(spark, path)


def folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def bytes_of(table: DataFrame) -> int:
    """Of the files of a stored table."""
    spark = table.sparkSession
    total = 0
    for path in folders(table):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of store() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    KEPT.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and let Spark clean up the shuffles of finished steps."""
    spark = SparkSession.getActiveSession()
    for df in tables:
        for path in folders(df):
            drop(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
