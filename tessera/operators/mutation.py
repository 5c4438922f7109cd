"""Insert, update and delete as new DataFrames; a write replaces the old state at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def update(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Rows that satisfy condition take the new values, all computed from the old row."""
    return df.select(*(F.when(condition, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in df.dtypes))


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not satisfy condition; those for which it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def write_by_rid(df: DataFrame, changes: DataFrame, rid: str = "rid") -> DataFrame:
    """Rows whose rid is among changes (rid and some of df's columns) take those columns' values, nulls included; strings
    and binaries may grow or shrink. rids of changes that df lacks change nothing; a rid should be there once."""
    known = [c for c in changes.columns if c != rid]
    new = changes.select(F.col(rid), F.struct(*known).alias("_new"))
    return df.join(new, rid, "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).cast(t).alias(c) if c in known else F.col(c) for c, t in df.dtypes))


def expand_by_rid(df: DataFrame, column: str, pieces: DataFrame, rid: str = "rid") -> DataFrame:
    """Strings or binaries of the rows that pieces (rid, piece) names, with the piece appended."""
    return df.join(pieces.select(rid, F.col("piece").alias("_piece")), rid, "left").select(*(F.when(F.col("_piece").isNull(), F.col(column)).otherwise(F.concat(column, "_piece")).alias(column) if c == column else F.col(c) for c in df.columns))


def delete_by_rid(df: DataFrame, rids: DataFrame, rid: str = "rid") -> DataFrame:
    return df.join(rids.select(rid), rid, "left_anti")


def insert_index(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, rid) pairs added to an index; a pair is there once."""
    return index.unionByName(pairs).distinct()


def delete_index(index: DataFrame, pairs: DataFrame) -> DataFrame:
    return index.join(pairs, ["key", "rid"], "left_anti")
