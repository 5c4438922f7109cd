"""Edges (src, dst) and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge once, from its smaller id, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def adjacency(edges: DataFrame, block: int = 100_000) -> DataFrame:
    """(id, block, neighbours): ascending adjacency lists, long ones split into blocks of at most `block` neighbours."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    dealt = edges.select("src", "dst", F.floor(place / block).cast("int").alias("block"))
    return dealt.groupBy(F.col("src").alias("id"), "block").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) over distinct undirected edges."""
    one = undirected(edges)
    return one.unionByName(reverse(one)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_order(edges: DataFrame) -> DataFrame:
    """(id, degree, position): 0-based ordinals by ascending degree, then id."""
    from tessera.operators.scans import numbered

    return numbered(degree(edges), "degree", "id").withColumnRenamed("rid", "position")


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common): neighbours that both ends of each pair (a, b) share."""
    near = symmetric(edges)
    one = pairs.join(near.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a")
    both = one.join(near.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).cast("long").alias("common"))
