"""Joins; strategies are Catalyst's, skewed keys are split by adaptive execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import OPERATORS


def self_equi_join(df: DataFrame, key: str, columns: list[str], condition: Column | None = None) -> DataFrame:
    """All pairs of rows with equal key, a row with itself included, in both orders: left_* and right_* columns.

    condition restricts rows before the join; it may only use columns of df.
    """
    rows = df if condition is None else df.where(condition)
    left, right = (rows.select(F.col(key), *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in ("left", "right"))
    return left.join(right, key)


def pointer_join(pointers: DataFrame, pointer: str, target: DataFrame, rid: str = "rid") -> DataFrame:
    """Rows of target that pointers name, beside the pointer's own columns."""
    return pointers.join(target, pointers[pointer] == target[rid])


def compare_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, *equal: str) -> DataFrame:
    """Rows whose columns a and b compare as op says, among those that agree in the `equal` columns."""
    joined = left.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in equal])
    return joined.where(OPERATORS[op](F.col(f"l.{a}"), F.col(f"r.{b}")))


def semi(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def anti(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")
