"""Graph operators on hand cases."""

import random

from pyspark.sql import functions as F

from tessera.graph import components, model, program, ranking, traversal, triangles

ARCS = [(0, 1), (0, 2), (1, 2), (2, 3), (4, 5)]


def edges(spark, pairs=ARCS):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_bfs_levels_and_log(spark):
    found = traversal.bfs(edges(spark), 0)
    assert {(r["id"], r["level"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert sorted(tuple(r) for r in traversal.bfs_log(found).collect()) == [(0, 2), (1, 1)]


def test_components_with_isolated_vertex(spark):
    labels = components.weakly_connected(edges(spark), spark.range(7))
    assert {tuple(r) for r in labels.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6)}
    assert tuple(components.component_summary(labels).first()) == (3, 1, 2)


def test_components_of_a_long_path(spark):
    path = edges(spark, [(i, i + 1) for i in range(300, 0, -1)])
    assert {r["label"] for r in components.weakly_connected(path).collect()} == {1}


def test_shortest_paths(spark):
    assert [r["id"] for r in traversal.shortest_path(edges(spark), 0, 3).orderBy("pos").collect()] == [0, 2, 3]
    assert traversal.shortest_path(edges(spark), 0, 5).count() == 0
    weighted = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "src long, dst long, weight double")
    assert [r["id"] for r in traversal.shortest_path(weighted, 0, 2, "weight").orderBy("pos").collect()] == [0, 1, 2]


def test_dfs_marks_when_pushed(spark):
    assert [r["id"] for r in traversal.dfs(edges(spark), 0).orderBy("position").collect()] == [0, 2, 3, 1]


def plain_walk(near, root):
    stack, marked, order = [root], {root}, []
    while stack:
        order.append(stack.pop())
        fresh = [n for n in sorted(set(near(order[-1]))) if n not in marked]
        marked.update(fresh)
        stack += fresh
    return list(enumerate(order))


def test_dfs_of_more_than_two_million_edges(spark):
    n, wide = 3000, 400
    band = spark.range(n).withColumnRenamed("id", "src").withColumn("dst", F.explode(F.sequence(F.greatest(F.col("src") - wide, F.lit(0)), F.least(F.col("src") + wide, F.lit(n - 1)))))
    assert band.count() > 2_000_000
    assert sorted(tuple(r) for r in traversal.dfs(band, 1).collect()) == plain_walk(lambda i: range(max(i - wide, 0), min(i + wide, n - 1) + 1), 1)


def test_dfs_of_odd_edges(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(-300, 300) * 10**15, draw.randrange(-300, 400) * 10**15) for _ in range(900)]
    pairs += pairs[:50] + [(pairs[0][0], None), (None, pairs[0][0]), (None, None)]
    near = {}
    for a, b in pairs:
        if a is not None and b is not None:
            near.setdefault(a, []).append(b)
    root = pairs[0][0]
    assert sorted(tuple(r) for r in traversal.dfs(edges(spark, pairs), root).collect()) == plain_walk(lambda i: near.get(i, ()), root)
    for found in (traversal.dfs(edges(spark), 9), traversal.dfs(edges(spark, []), 9)):
        assert [tuple(r) for r in found.collect()] == [(0, 9)]


def test_triangles(spark):
    both = edges(spark, ARCS + [(1, 0)])
    assert triangles.triangle_total(both).first()[0] == 1
    assert {tuple(r) for r in triangles.triangles_per_vertex(both).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_pagerank_of_one_iteration_is_uniform(spark):
    assert {r["rank"] for r in ranking.pagerank(edges(spark), 1).collect()} == {1 / 6}


def test_forward_paths_count_repeats(spark):
    ring = edges(spark, [(i, (i + k) % 9) for i in range(9) for k in (1, 2, 3)])
    assert sum(r["paths"] for r in traversal.paths(ring, 0, 7).collect()) == sum(3**k for k in range(8))


def test_vertex_program(spark):
    both = model.symmetric(edges(spark))
    found = program.run(program.MinLabel(), model.vertices(both), both)
    assert {tuple(r) for r in found.state.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4)}
    assert found.log[-1] == 0


def test_long_paths_by_doubling(spark):
    path = edges(spark, [(i, i + 1) for i in range(21)])
    assert [r["id"] for r in traversal.shortest_path(path, 0, 21).orderBy("pos").collect()] == list(range(22))
    assert [tuple(r) for r in traversal.shortest_path(path, 3, 3).collect()] == [(0, 3)]
    assert traversal.bfs(path, 0, 4).agg({"level": "max"}).first()[0] == 4


def test_adjacency_blocks(spark):
    star = edges(spark, [(0, i) for i in range(1, 8)] + [(1, 2)])
    assert {(r["id"], r["block"], tuple(r["neighbours"])) for r in model.adjacency(star, 3).collect()} == {(0, 0, (1, 2, 3)), (0, 1, (4, 5, 6)), (0, 2, (7,)), (1, 0, (2,))}


def test_trees(spark):
    nodes = spark.createDataFrame([(1, 2, 3, "a"), (2, None, 4, "b"), (3, None, None, "c"), (4, None, None, "d")], "rid long, left long, right long, v string")
    read = traversal.tree_read(nodes, nodes.where("rid = 1"), 1)
    assert {tuple(r) for r in read.collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1)}
    assert {(r["rid"], r["v"]) for r in traversal.rewrite_leaves(nodes, read, {"v": F.lit("new")}).collect()} == {(1, "a"), (2, "b"), (3, "new"), (4, "d")}
