"""The index against brute force, on more rows than are reranked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest


def exact(ids, x, k):
    """query to its k nearest (id, cosine), ties to the smaller id."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in np.flatnonzero(ids % 50 == 0):
        s = u @ u[a]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[a]][:k]
        out[int(ids[a])] = {int(ids[i]): float(s[i]) for i in order}
    return out


@pytest.mark.parametrize(("n", "dim", "centres"), [(3000, 24, 0), (6000, 32, 40)])
def test_recall(spark, n, dim, centres):
    """Vectors without structure, the hardest case, and in groups, over one shard and over two."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim))
    if centres:
        x += 4 * rng.normal(size=(centres, dim))[rng.integers(0, centres, n)]
    assert n * nearest.FRACTION > nearest.LEAST
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, shard string").repartition(4)
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(np.arange(n), x, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for _, i, _ in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - u[q] @ u[i]) < 1e-12 for _, i, s in found)
        assert [(s, -i) for _, i, s in found] == sorted(((s, -i) for _, i, s in found), reverse=True)


def test_no_rows_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [-1.0, 0.0]), (50, [0.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert nearest.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest.nearest(df, F.lit(False)).count() == 0
    got = nearest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2)]
