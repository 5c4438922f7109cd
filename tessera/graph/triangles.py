"""Triangles: every undirected edge is oriented towards the end of higher (degree, id), so no vertex has many out-edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph.model import degree, undirected
from tessera.plans.lineage import table


def oriented(edges: DataFrame) -> DataFrame:
    """(u, v) with (degree, id) of u below that of v."""
    one = table(undirected(edges), "edges")
    rank = table(degree(one), "degrees")
    for end in ("src", "dst"):
        one = one.join(rank.select(F.col("id").alias(end), F.col("degree").alias(f"{end}_degree")), end)
    low = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    return one.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): every triangle once."""
    e = table(oriented(edges), "oriented")
    ab, ac, bc = e.toDF("a", "b"), e.toDF("a", "c"), e.toDF("b", "c")
    return ab.join(ac, "a").join(bc, ["b", "c"]).select("a", "b", "c")


def triangle_total(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """(id, triangles) of vertices in at least one."""
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
