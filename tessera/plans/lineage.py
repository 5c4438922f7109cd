"""Written tables that cut lineage between supersteps, and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers that may be broadcast: some tens of MB.
NARROW = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that is unset, a temporary folder serves a session whose executors are threads of this process; on a cluster
    it would be another one on each machine, so there an error asks for the setting.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{_own_dir(spark.sparkContext.applicationId)}"


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps neither recompute it nor depend on an executor."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._tessera_path = path
    return again


def written(df: DataFrame, name: str) -> DataFrame:
    """df itself if it is a table() as it was written, else a table() of it: what a loop joins again and again."""
    return df if hasattr(df, "_tessera_path") else table(df, name)


def joined_tables(parts: list[DataFrame]) -> DataFrame:
    """The rows of table()s of one schema, as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p._tessera_path for p in parts))


def forget(df: DataFrame) -> None:
    """Deletes a table() that no result depends on any more."""
    spark, path = df.sparkSession, df._tessera_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 200_000, size: int | None = None) -> DataFrame:
    """Marks df for broadcast if it was counted to hold at most so many rows; else it is left to a shuffled join.

    df should be cheap to count: a table(), or an aggregate of one. Where rows may be wide, size bounds the bytes that
    Spark knows df's files to hold.
    """
    if size is not None and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > size:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
