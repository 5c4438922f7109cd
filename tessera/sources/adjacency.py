"""Binary and text sources of graphs and fixed-width records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of files that hold int32 src, int32 degree and degree int32 dst, again and again.

    dst is null once for a node without arcs, so that its id is known; see arcs(). Where a record begins is known only from
    the records before it, so a file is one task: files must be under the 2 GB that one binary value may have, and larger
    graphs several files.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content in batch.column(0).to_pylist():
                x = np.frombuffer(content, "<i4").astype(np.int64)
                heads, at = [], 0
                while at + 1 < len(x):
                    heads.append(at)
                    at += 2 + x[at + 1]
                head = np.array(heads, np.int64)
                for lo in range(0, len(head), 1 << 16):  # some records at a time
                    h = head[lo : lo + (1 << 16)]
                    n = np.minimum(x[h + 1], len(x) - h - 2)
                    rows_ = np.maximum(n, 1)
                    first = np.cumsum(rows_) - rows_
                    src = np.repeat(x[h], rows_)
                    place = np.repeat(h + 2 - first, rows_) + np.arange(rows_.sum())
                    none = np.repeat(n == 0, rows_)
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(x[np.where(none, 0, place)], mask=none)], ["src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long")


def arcs(stream: DataFrame) -> DataFrame:
    return stream.where("dst IS NOT NULL")


def dense_vertices(stream: DataFrame) -> DataFrame:
    """Every id from 0 to the largest that occurs."""
    top = stream.agg(F.max(F.greatest("src", F.coalesce("dst", "src")))).first()[0]
    return stream.sparkSession.range(0 if top is None else top + 1)


#: Types of attribute files: what numpy calls them, and the column they become.
ATTRIBUTES = {"<i4": "int", "<i8": "long", "<f4": "float", "<f8": "double"}


def read_attribute(spark: SparkSession, path: str, dtype: str = "<i4") -> DataFrame:
    """(id, value) of a raw array file: element i belongs to node i; value has the element's own type.

    path must lead to one file of under 2 GB: elements of several would not be numbered on, so that is an error. What
    write_attribute() has written has no such bound.
    """
    raw = spark.read.format("binaryFile").load(path)
    if raw.select("path").limit(2).count() != 1:
        raise ValueError(f"{path} must be one file")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content in batch.column(0).to_pylist():
                x = np.frombuffer(content, dtype, count=len(content) // np.dtype(dtype).itemsize)
                for lo in range(0, len(x), 1 << 20):
                    some = x[lo : lo + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(some))), pa.array(some.astype(some.dtype.newbyteorder("=")))], ["id", "value"])

    return raw.select("content").mapInArrow(run, f"id long, value {ATTRIBUTES[dtype]}")


def write_attribute(values: DataFrame, path: str) -> DataFrame:
    """Writes (id, value) as Parquet laid out by ranges of id, replacing what is there, and reads it back."""
    values.select("id", "value").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
    return values.sparkSession.read.schema(values.select("id", "value").schema).parquet(path)


def write_results(lines: DataFrame, path: str) -> None:
    """Appends one string column as text lines to the result folder at path."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("append").text(path)


def read_fixed(spark: SparkSession, path: str, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Fixed-width text lines: name to (first column, length, type); what is no value of its type is null."""
    cut: list[Column] = [F.trim(F.substring("value", a + 1, n)).try_cast(t).alias(c) for c, (a, n, t) in fields.items()]
    return spark.read.text(path).where("trim(value) <> ''").select(*cut)


#: Columns of the student file.
STUDENT = {"id": (0, 3, "int"), "name": (3, 20, "string"), "sex": (23, 1, "string"), "age": (25, 2, "int"), "yr": (28, 1, "int"), "gpa": (30, 3, "float")}
