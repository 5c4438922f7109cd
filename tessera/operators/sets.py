"""Duplicate elimination, unique insertion and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """A key that must be unique occurs more than once."""


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct() if keys else df.distinct()


def unique_insert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those rows whose key it lacks; of rows with equal keys one, the least of all columns, goes in."""
    one = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return target.unionByName(one.join(target.select(key), key, "left_anti").select(*target.columns))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if duplicates(df, *keys).limit(1).count():
        raise DuplicateKey(", ".join(keys))
    return df


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
