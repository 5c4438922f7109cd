"""Connected components by distributed union-find, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import NARROW, forget, table


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, label): the smallest id that each id of links (a, b) reaches. Distributed union-find.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a min per node and a join, until
    nothing moves; the number of rounds grows with the logarithm of the longest path. Every round is a written table.
    Ids are long; a row with a = b or a null is ignored, and repeated rows count once.
    """
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(edges)
    while True:
        # Minima of few edges are broadcast; else written first, so that the join meets plain exchanges, which Spark splits where a hub skews them.
        near = F.broadcast if mark[0] <= NARROW // 2 else lambda df: table(df, "least")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(near(least), "u")
        after = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).distinct()
        after = table(after, name)
        now = _mark(after)
        forget(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def weakly_connected(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, label): components of edges (src, dst) without regard to direction, labelled by their smallest id.

    vertices (id) adds ids without edges, each its own component; by default the ends of edges are the vertices.
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    every = (ends if vertices is None else ends.unionByName(vertices.select("id"))).where("id IS NOT NULL").distinct()
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return every.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def component_summary(labels: DataFrame) -> DataFrame:
    """(total_components, size_one, larger)."""
    one = F.count_if(F.col("size") == 1)
    return component_sizes(labels).agg(F.count("*").alias("total_components"), one.alias("size_one"), (F.count("*") - one).alias("larger"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7L))")).first())
