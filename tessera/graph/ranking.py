"""PageRank with a fixed number of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph.model import out_degree, vertices
from tessera.plans.lineage import NARROW, forget, small, table, written


def pagerank(edges: DataFrame, iterations: int = 5, damping: float = 0.85, ids: DataFrame | None = None) -> DataFrame:
    """(id, rank) in double precision. The first iteration sets 1/N, so K iterations are K - 1 power steps; the rank of
    vertices without out-edges is not handed on. The degree is joined once, and map-side sums precede each shuffle."""
    edges = written(edges.select("src", "dst"), "edges")
    ids = table((vertices(edges) if ids is None else ids.select("id")).distinct(), "vertices")
    n = ids.count()
    degrees = table(out_degree(edges).withColumnRenamed("id", "src"), "degrees")
    arcs = table(edges.join(small(degrees, NARROW), "src"), "arcs")
    rank = table(ids.withColumn("rank", F.lit(1.0 / max(n, 1))), "rank")
    near = F.broadcast if n <= NARROW else lambda df: df
    for _ in range(iterations - 1):
        sent = arcs.join(near(rank.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        last, rank = rank, table(ids.join(sent, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("sum", F.lit(0.0))).alias("rank")), "rank")
        forget(last)
    return rank
