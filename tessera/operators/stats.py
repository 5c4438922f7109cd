"""Cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_card(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"))


def key_card(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("keys"))


def total(df: DataFrame, column: str) -> DataFrame:
    """The sum over all rows, added up in each task first."""
    return df.agg(F.sum(column).alias("total"))


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pages(df: DataFrame) -> int:
    """Input files, the nearest thing to a file's pages."""
    return len(df.inputFiles())
