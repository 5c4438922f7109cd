"""Shared plumbing of this subpackage, on top of the library's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph.components import components
from tessera.plans.lineage import NARROW, forget, shared_dir, small, table

__all__ = ["NARROW", "columns", "components", "forget", "free", "merged", "shared_dir", "small", "table", "tidy"]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that extra ones cannot clash with an operator's own."""
    return df.select(*(df[n] for n in names))


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from df's columns: what an operator calls a column
    that it adds to those of its input."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """components() of the links behind labels and of more (a, b) together: only labels are contracted any further."""
    for k in "ab":
        of = labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"))
        more = more.join(of, k, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", k))
    ends = table(more.select("a", "b", F.col("la").alias("la"), F.col("lb").alias("lb")), "ends")
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), "label-links").select(F.col("id").alias("label"), F.col("label").alias("now"))
    alone = ends.select(F.col("a").alias("id"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("id"), F.col("lb").alias("label"))).where("id = label").distinct()
    every = labels.unionByName(alone).distinct()
    return every.join(moved, "label", "left").select("id", F.coalesce("now", "label").alias("label"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back a task's memory at its end: Spark keeps Python workers for later stages."""

    def wrapped(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(rows)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped
