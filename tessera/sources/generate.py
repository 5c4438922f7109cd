"""Synthetic relations, generated where they are used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation, generator and prime of the multiplicative congruential sequence.
SEQUENCES = [(1_000, 279, 1009), (10_000, 2969, 10007), (100_000, 21395, 100003), (1_000_000, 2107, 1000003), (10_000_000, 211, 10000019), (100_000_000, 21, 100000007)]


def _letters(number: Column) -> Column:
    """Six base-26 digits, least significant first, padded with x to 52."""
    return F.rpad(F.concat(*(F.chr(F.lit(65) + F.floor(number / 26**i).cast("int") % 26) for i in range(6))), 52, "x")


def permutation(spark: SparkSession, n: int, blocks: int = 32) -> DataFrame:
    """(step, unique1): the n values 0..n-1 in the order of the sequence.

    Step k of the sequence is generator**(k+1) mod prime, so every block starts from a power of its own; values over n
    are skipped, and step keeps the order.
    """
    if n > SEQUENCES[-1][0]:
        raise ValueError(f"the sequence is defined for at most {SEQUENCES[-1][0]} rows")
    generator, prime = next((g, p) for limit, g, p in SEQUENCES if n <= limit)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in (b for r in rows for b in r["id"]):
            lo, hi = block * (prime - 1) // blocks, (block + 1) * (prime - 1) // blocks
            seed, steps, values = pow(generator, lo + 1, prime), [], []
            for k in range(lo, hi):
                if seed <= n:
                    steps.append(k)
                    values.append(seed - 1)
                seed = seed * generator % prime
            yield pd.DataFrame({"step": steps, "unique1": values}, dtype="int64")

    return spark.range(0, blocks, 1, blocks).mapInPandas(run, "step long, unique1 long")


def wisconsin(spark: SparkSession, n: int) -> DataFrame:
    """The benchmark relation of n rows; unique2 is the row's place in generation order."""
    from tessera.operators.scans import numbered

    rows = numbered(permutation(spark, n), "step").withColumnRenamed("rid", "unique2")
    u = F.col("unique1")
    ints = {f"{name}": u % k for name, k in (("two", 2), ("four", 4), ("ten", 10), ("twenty", 20))} | {name: F.floor(u / k) for name, k in (("onePercent", 100), ("tenPercent", 10), ("twentyPercent", 5), ("fiftyPercent", 2))}
    cycle = F.element_at(F.array(*(F.lit(c * 4) for c in "AHOV")), (F.col("unique2") % 4 + 1).cast("int"))
    made = rows.select(u.cast("int"), F.col("unique2").cast("int"), *(c.cast("int").alias(k) for k, c in ints.items()), u.cast("int").alias("unique3"))
    return made.select(
        "*", (2 * F.col("onePercent") + 1).alias("oddOnePercent"), (2 * F.col("onePercent")).alias("evenOnePercent"), _letters(F.col("unique1")).alias("string1"), _letters(F.col("unique2")).alias("string2"), F.rpad(cycle.alias("c"), 52, "x").alias("string3")
    )


def part_graph(spark: SparkSession, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(parts, links) of n parts with three out-links each, nine in ten of them to one of the nearest hundredth of ids."""
    r = lambda salt, k=0: (F.col("partId") * 48271 + (salt * 40692 + k * 69621 + seed)) % 2147483647 * 16807 % 2147483647
    ids = spark.range(1, n + 1).withColumnRenamed("id", "partId")
    parts = ids.select("partId", (r(1) % 100_000).alias("x"), (r(2) % 100_000).alias("y"), (r(3) % 315_360_000).alias("date"), F.format_string("type%03d", (r(4) % 10).cast("int")).alias("type"))
    near = max(1, n // 100)
    links = ids.select("partId", F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), r(5, k).alias("a"), r(6, k).alias("b"), r(7, k).alias("c")) for k in range(3)))).alias("l"))
    close = F.pmod(F.col("partId") - 1 + F.col("l.b") % near - near // 2, F.lit(n)) + 1
    return parts, links.select(F.col("partId").alias("src"), "l.pos", F.when(F.col("l.a") % 10 < 9, close).otherwise(F.col("l.b") % n + 1).alias("dst"), (F.col("l.c") % 1000).cast("int").alias("length"))


def boolean_records(spark: SparkSession, n: int = 10) -> DataFrame:
    """Records with one field per comparable type."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("k_int"), F.concat(F.lit("key-"), i).alias("k_str"), F.floor(i / 2).cast("short").alias("k_short"), (i + 1).cast("float").alias("k_float"), (2 * i).alias("k_long"), (i * i).cast("double").alias("k_double"))
