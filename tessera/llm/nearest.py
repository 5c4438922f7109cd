"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The pivots are a bounded sample (PIVOTS rows, those of smallest
hash); every row is indexed. Rows are dealt to shards of about SHARD rows; in a shard each pivot has an inverted file of
(row, rank), and a query adds up, over its own pivots' files, what those shared ranks take off the footrule distance of
the two prefixes. The best FRACTION of the shard (at least LEAST rows, all ties at the border included) are reranked by
exact cosine. Queries meet shards in blocks, so a task holds at most SHARD rows and BLOCK queries; a query goes through the
files of its own pivots only, which hold PREFIX / PIVOTS of a shard's rows each.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor does a null
id; vectors are compared only with those of equal length; a row with the query's id is no candidate; ties go to the
smaller id; repeated candidates count once, whichever of the vectors under one id is nearest; vectors of any length are
read whole; other columns are ignored, whatever their names; no rows, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import columns, table

PIVOTS, PREFIX, SHARD, BLOCK = 512, 64, 4096, 1024
FRACTION, LEAST = 0.1, 64


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) with vectors as bytes of doubles; rows that take no part are gone."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes())  # exact, and squares stay finite
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vector"])

    return columns(vectors, "vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, vector binary")


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to PIVOTS distinct unit vectors of each length, out of a bounded sample of rows."""
    found: dict[int, dict[bytes, None]] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(4 * PIVOTS).collect():
        mine = found.setdefault(r["dim"], {})
        if len(mine) < PIVOTS:
            mine[bytes(r["vector"])] = None
    return {dim: unit(np.array([np.frombuffer(v) for v in some])) for dim, some in found.items()}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def index(rows: DataFrame, chosen: dict[int, np.ndarray]) -> DataFrame:
    """Adds prefix: the PREFIX nearest pivots of each vector, nearest first, as 16-bit numbers (empty where none of its length were sampled)."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            prefix: list[bytes] = [b""] * len(raw)
            for dim in np.unique(dims):
                if (p := shared.value.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    near = unit(np.array([np.frombuffer(raw[i]) for i in at])) @ p.T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :PREFIX].astype(np.uint16)
                    for i, b in zip(at, best, strict=True):
                        prefix[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefix, pa.binary())], ["vec_id", "dim", "vector", "prefix"])

    return rows.mapInArrow(run, "vec_id long, dim int, vector binary, prefix binary")


def _search(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of one block."""
    ids, vectors = rows["vec_id"].to_numpy(), np.array([np.frombuffer(v) for v in rows["vector"]])
    norms = np.sqrt((vectors * vectors).sum(1))
    prefix = np.array([np.frombuffer(p, np.uint16) for p in rows["prefix"]])
    length, n = prefix.shape[1], len(ids)
    order = np.argsort(prefix.ravel(), kind="stable")
    owner, rank = order // max(1, length), order % max(1, length)
    starts = np.searchsorted(prefix.ravel()[order], np.arange(PIVOTS + 1))
    wanted = min(n, max(LEAST, int(np.ceil(FRACTION * n))))
    out = []
    for query, vector, perm in zip(asked["vec_id"], asked["vector"], asked["prefix"], strict=True):
        own = np.frombuffer(perm, np.uint16)
        first, files = starts[own], starts[own + 1] - starts[own]
        at = np.repeat(first - np.cumsum(files) + files, files) + np.arange(files.sum())  # the places of the query's own files, end to end
        shared = np.bincount(owner[at], length - np.maximum(rank[at], np.repeat(np.arange(len(own)), files)), n)
        some = np.flatnonzero(shared >= np.partition(shared, n - wanted)[n - wanted])
        some = some[ids[some] != query]
        q = np.frombuffer(vector)
        score = (vectors[some] * q).sum(1) / (norms[some] * np.sqrt((q * q).sum()))
        best, seen = [], set()
        top = np.lexsort((ids[some], -score))
        for i in top:
            if len(best) == k:
                break
            if ids[some[i]] not in seen:
                seen.add(ids[some[i]])
                best.append(i)
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[some[best]], "score": np.clip(score[best], -1.0, 1.0)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors (vec_id, embedding) for which queries holds."""
    rows = table(clean(vectors), "vectors")
    indexed = table(index(rows, pivots(rows)), "permutations")
    asked = indexed.where(queries).dropDuplicates(["vec_id"])
    shards = max(1, -(-indexed.count() // SHARD))
    blocks = max(1, -(-asked.count() // BLOCK))
    left = indexed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _search(rows, asked, k)

    key = ["shard", "block", "dim"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
