"""Breadth-first and depth-first search, shortest paths, and depth-bounded traversals.

Edges are written once. Every superstep is one join of the frontier with them, written as a table of its own; the
frontier is broadcast only while it was counted to be small.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import NARROW, forget, joined_tables, small, table, written


def bfs(edges: DataFrame, root: int, depth: int | None = None) -> DataFrame:
    """(id, level, parent) of what root reaches: parent is the smallest neighbour one level up, null for root."""
    edges = written(edges.select("src", "dst"), "edges")
    levels, n = [table(edges.sparkSession.createDataFrame([(root, 0, None)], "id long, level int, parent long"), "bfs")], 1
    while depth is None or len(levels) <= depth:
        frontier = levels[-1].select(F.col("id").alias("src"))
        reached = edges.join(F.broadcast(frontier) if n <= NARROW else frontier, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = table(reached.join(joined_tables(levels).select("id"), "id", "left_anti").select("id", F.lit(len(levels)).alias("level"), "parent"), "bfs")
        n = new.count()
        if not n:
            forget(new)
            break
        levels.append(new)
    return joined_tables(levels)


def bfs_log(levels: DataFrame) -> DataFrame:
    """(iteration, visited): vertices newly visited in each iteration, the root not counted."""
    return levels.where("level > 0").groupBy((F.col("level") - 1).alias("iteration")).agg(F.count("*").alias("visited"))


def dfs(edges: DataFrame, root: int) -> DataFrame:
    """(position, id): the order in which a stack search visits what root reaches, neighbours being marked when pushed in
    ascending order and so popped largest first. An edge with a null end is ignored.

    The order is sequential by nature, so one task walks all edges, which come to it sorted by their source. It keeps them
    in files beside Spark's own spills, 8 bytes an edge and 24 a vertex, and one byte a vertex in memory; the driver gets
    none of them.
    """
    one = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    arcs = table(one.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    none = F.lit(None).cast("long").alias("dst")
    # Each vertex once more, without an edge, so that those which no edge leaves are known too; root even if it has no edge.
    ends = arcs.select(F.col("dst").alias("src")).distinct().select("src", none)
    start = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("src"), none)
    every = arcs.unionByName(ends).unionByName(start).repartition(1).sortWithinPartitions("src")
    found = table(every.mapInArrow(_walk(root), "position long, id long"), "dfs")
    forget(arcs)
    return found


def _walk(root: int, block: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that takes the rows of dfs() and yields its order, both in blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        with ExitStack() as closing:
            ids, stops, near, stack = (closing.enter_context(tempfile.TemporaryFile(dir=folder)) for _ in range(4))
            stops.write(np.zeros(1, np.int64))
            last, n = None, 0
            for batch in rows:
                if not batch.num_rows:
                    continue
                src, real = batch.column("src").to_numpy(), batch.column("dst").is_valid()
                first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
                own, stop = src[first], n + np.cumsum(np.add.reduceat(real.to_numpy(zero_copy_only=False), first, dtype=np.int64))
                near.write(batch.column("dst").filter(real).to_numpy())
                if last is not None and last[0] != own[0]:  # else it goes on in this batch
                    ids.write(last[0])
                    stops.write(last[1])
                ids.write(own[:-1])
                stops.write(stop[:-1])
                last, n = (own[-1], stop[-1]), int(stop[-1])
            ids.write(last[0])
            stops.write(last[1])
            stack.truncate(ids.tell())
            ids, stops, near, stack = _mapped(ids), _mapped(stops), _mapped(near), _mapped(stack)
            for at in range(0, n, block):  # from ids to their ranks, which order alike
                near[at : at + block] = np.searchsorted(ids, near[at : at + block])
            marked = np.zeros(len(ids), bool)
            stack[0] = np.searchsorted(ids, root)
            marked[stack[0]] = True
            top, visited, order = 1, 0, []
            while top:
                top -= 1
                node = int(stack[top])
                order.append(node)
                fresh = near[stops[node] : stops[node + 1]]
                fresh = fresh[~marked[fresh]]
                if len(fresh):
                    fresh.sort()
                    marked[fresh] = True
                    stack[top : top + len(fresh)] = fresh
                    top += len(fresh)
                if len(order) == block or not top:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(visited, visited + len(order))), pa.array(ids[order])], ["position", "id"])
                    visited, order = visited + len(order), []

    return run


def _mapped(file: BinaryIO) -> np.ndarray:
    """The numbers in file, read and written in place: they take memory only while there is some to spare."""
    file.flush()
    return np.memmap(file, np.int64, "r+").view(np.ndarray) if file.seek(0, os.SEEK_END) else np.empty(0, np.int64)


def distances(edges: DataFrame, root: int, weight: str = "weight") -> DataFrame:
    """(id, distance, parent) under non-negative edge weights: relaxation of what changed, to a fixpoint."""
    spark = edges.sparkSession
    edges = table(edges.select("src", "dst", F.col(weight).cast("double").alias("weight")), "edges")
    best = table(spark.createDataFrame([(root, 0.0, None, True)], "id long, distance double, parent long, active boolean"), "distances")
    while best.where("active").limit(1).count():
        moved = edges.join(best.where("active").select(F.col("id").alias("src"), "distance"), "src")
        offered = moved.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("parent"))).alias("o"))
        joined = best.withColumnRenamed("distance", "d").withColumnRenamed("parent", "p").join(offered, "id", "full")
        better = F.col("o").isNotNull() & (F.col("d").isNull() | (F.col("o.distance") < F.col("d")))
        last, best = best, table(joined.select("id", F.when(better, F.col("o.distance")).otherwise(F.col("d")).alias("distance"), F.when(better, F.col("o.parent")).otherwise(F.col("p")).alias("parent"), better.alias("active")), "distances")
        forget(last)
    return best.select("id", "distance", "parent")


def shortest_path(edges: DataFrame, root: int, goal: int, weight: str | None = None) -> DataFrame:
    """(pos, id) from root to goal; no rows if goal is out of reach. Ties go to the smallest parent.

    The way back from goal is found by doubling: tables of ancestors 1, 2, 4, ... steps up as far as goal has any, then
    unrolled backwards, so a path of n steps takes log2(n) joins each way.
    """
    tree = (distances(edges, root, weight) if weight else bfs(edges, root)).select("id", F.col("parent").alias("up"))
    jumps = []
    jump = table(tree.where("up IS NOT NULL"), "jump")
    while jump.where(F.col("id") == goal).limit(1).count():
        jumps.append(jump)
        jump = table(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "jump")
    forget(jump)
    path = tree.where(F.col("id") == goal).select("id", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        more = jumps[k].join(path, "id").select(F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        path = table(path.unionByName(more), "path")
        forget(jumps[k])
    steps = path.agg(F.max("back")).first()[0]
    return path.select((F.lit(steps).cast("long") - F.col("back")).alias("pos"), "id")


def paths(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """(depth, id, paths): how many paths of each length up to depth lead from root to each vertex, repeats counted."""
    edges = written(edges.select("src", "dst"), "edges")
    out = [table(edges.sparkSession.createDataFrame([(0, root, 1)], "depth int, id long, paths long"), "paths")]
    for d in range(1, depth + 1):
        step = edges.join(small(out[-1].select(F.col("id").alias("src"), "paths"), NARROW), "src")
        now = step.groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")).select(F.lit(d).alias("depth"), "id", "paths")
        out.append(table(now, "paths"))
    return joined_tables(out)


def tree_read(nodes: DataFrame, roots: DataFrame, depth: int, follow: Column | None = None) -> DataFrame:
    """(root, rid, level): objects of binary trees reached from roots (rid) in at most `depth` steps, level by level.

    nodes: (rid, left, right), a null child being none. follow, over the child's rid, says which children are gone down
    to; by default all are. An object reached twice from one root is there twice, as the tree says.
    """
    nodes = written(nodes.select("rid", "left", "right"), "nodes")
    out = [table(roots.select(F.col("rid").alias("root"), "rid", F.lit(0).alias("level")), "tree")]
    for d in range(1, depth + 1):
        child = nodes.join(small(out[-1], NARROW), "rid").select("root", F.explode(F.array("left", "right")).alias("rid"), F.lit(d).alias("level"))
        child = child.where("rid IS NOT NULL")
        out.append(table(child if follow is None else child.where(follow), "tree"))
    return joined_tables(out)


def rewrite_leaves(nodes: DataFrame, read: DataFrame, values: dict[str, Column]) -> DataFrame:
    """nodes with new values in the leaves, objects without children, that read (rid, ...) has reached."""
    reached = read.select("rid").distinct().withColumn("_reached", F.lit(True))
    leaf = F.col("left").isNull() & F.col("right").isNull() & F.col("_reached")
    return nodes.join(reached, "rid", "left").select(*(F.when(leaf, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in nodes.dtypes))
