"""Sorting, clustered layout and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Ascending by key, then by ties: Spark's external sort."""
    return df.orderBy(key, *ties)


def sort_into(df: DataFrame, path: str, key: str, *ties: str) -> DataFrame:
    """A sorted copy as Parquet, replacing what is there; an empty input gives an empty copy."""
    sort(df, key, *ties).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, path: str, key: str, partitions: int | None = None) -> DataFrame:
    """A copy laid out by ranges of key, so that range scans skip row groups."""
    dealt = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top(df: DataFrame, column: str, k: int = 20, *ties: str) -> DataFrame:
    """The k largest, each task keeping k at most."""
    return df.orderBy(F.desc(column), *ties).limit(k)
