"""Scans and positional access. A scan is a lazy DataFrame; Catalyst pushes its predicate into the Parquet reader."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import Term, chain
from tessera.plans.lineage import table

Terms = Sequence[Term | Column]


def file_scan(df: DataFrame, terms: Terms = (), connective: str = "and") -> DataFrame:
    """Rows that satisfy a chain of terms."""
    return df.where(chain(terms, connective))


def index_scan(df: DataFrame, key: str, lower: Any = None, upper: Any = None, terms: Terms = (), connective: str = "and", lower_op: str = ">=", upper_op: str = "<=", ordered: bool = True) -> DataFrame:
    """Rows with key between the bounds (None: open; inclusive unless the operators say otherwise), in key order.

    lower_op "=" makes the lower bound the upper one too. ordered=False leaves the rows where they are.
    """
    if lower_op == "=":
        lower_op, upper_op, upper = ">=", "<=", lower
    bounds = [Term(key, op, v) for op, v in ((lower_op, lower), (upper_op, upper)) if v is not None]
    found = df.where(chain(bounds) & chain(terms, connective))
    return found.orderBy(key) if ordered else found


def hash_scan(df: DataFrame, key: str, value: Any, terms: Terms = (), connective: str = "and") -> DataFrame:
    """All rows with this key that satisfy the chain."""
    return df.where((F.col(key) == F.lit(value)) & chain(terms, connective))


def long_scan(df: DataFrame, column: str, offset: int, length: int) -> DataFrame:
    """A byte or character range of every item, clipped to its end, as `part`."""
    return df.withColumn("part", F.substring(column, offset + 1, length))


#: Rows of a stretch of ordinals: what positional windows are partitioned by.
STRETCH = 1 << 16


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with rid, its rows' 0-based ordinals in this order; use a total order, or ordinals of equal rows may vary.

    Distributed: rows are range-partitioned and numbered within their partition, and only the partitions' counts, one
    number each, go through the driver. The copy lies in the order of rid, so a lookup or a range of ordinals skips the
    row groups of others.
    """
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sorted_ = table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_within", within), "numbered")
    counts = {r["_part"]: r["n"] for r in sorted_.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, bases = 0, []
    for part in sorted(counts):
        bases += [F.lit(part), F.lit(base).cast("long")]
        base += counts[part]
    start = F.element_at(F.create_map(*bases), F.col("_part")) if bases else F.lit(0).cast("long")
    return table(sorted_.select(*df.columns, (start + F.col("_within")).alias("rid")), "ordinals")


def fetch_first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def fetch_last(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(1)


def _neighbour(df: DataFrame, columns: Sequence[str], prefix: str, step: int) -> DataFrame:
    """Looks `step` ordinals further inside stretches of them; rows are sent to another stretch only where it asks for them."""
    stretch = F.floor(F.col("rid") / STRETCH)
    there = F.floor((F.col("rid") - step) / STRETCH)
    own = df.withColumn("_stretch", stretch).withColumn("_guest", F.lit(False))
    guests = own.withColumn("_guest", F.lit(True)).withColumn("_stretch", there).where(there != stretch)
    there_ = Window.partitionBy("_stretch").orderBy("rid").rangeBetween(step, step)
    both = own.unionByName(guests).select(*df.columns, "_guest", *(F.first(c).over(there_).alias(f"{prefix}_{c}") for c in columns))
    return both.where("NOT _guest").drop("_guest")


def fetch_next(df: DataFrame, columns: Sequence[str], step: int = 1) -> DataFrame:
    """Numbered df with the given columns of the row `step` further on as next_*, null beyond the end."""
    return _neighbour(df, columns, "next", step)


def fetch_previous(df: DataFrame, columns: Sequence[str], step: int = 1) -> DataFrame:
    """Numbered df with the given columns of the row `step` before as previous_*, null before the start."""
    return _neighbour(df, columns, "previous", -step)


def adjacent_keys(df: DataFrame, key: str, value: Any, rid: str = "rid") -> DataFrame:
    """(rid, key) of the index entries next to a key value: the last below it and the first above it, as far as there are any."""
    below = df.where(F.col(key) < F.lit(value)).select(key, rid).orderBy(F.desc(key), F.desc(rid)).limit(1)
    above = df.where(F.col(key) > F.lit(value)).select(key, rid).orderBy(key, rid).limit(1)
    return below.unionByName(above).select(rid, key)


def from_position(df: DataFrame, rid: int) -> DataFrame:
    """Numbered df from an ordinal on."""
    return df.where(F.col("rid") >= rid)


def from_bookmark(df: DataFrame, key: str, value: Any, rid: int) -> DataFrame:
    """Numbered df after the row (value, rid), in the order of (key, rid)."""
    return df.where((F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & (F.col("rid") > rid))).orderBy(key, "rid")


def lookup(df: DataFrame, rid: int) -> DataFrame:
    return df.where(F.col("rid") == rid)


def cursor(df: DataFrame) -> Iterator[Row]:
    """Rows one after another, a partition at a time in the driver's memory."""
    return df.toLocalIterator()


def set_cursor(position: int, total: int, offset: int, whence: int) -> int:
    """A long item's cursor: whence 0 counts from the start, 1 from the position, 2 back from the end."""
    if whence not in (0, 1, 2):
        raise ValueError("whence is 0, 1 or 2")
    return offset if whence == 0 else position + offset if whence == 1 else total if offset == 0 else total - (offset + 1)
