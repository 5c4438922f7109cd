"""Pairs to verify out of buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import common
from tessera.llm.support import NARROW, small, table, tidy


def crowded(posted: DataFrame) -> DataFrame:
    """Distinct (bucket, id) of postings in buckets that hold several ids, a table."""
    several = table(posted.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket"), "buckets")
    return table(posted.join(small(several, NARROW), "bucket").select("bucket", "id").distinct(), "members")


def hub_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the distinct members (bucket, id) of buckets with several ids, a table: the same with (size, hub), a table, and
    the distinct pairs (a, b) of members and hubs.

    A bucket's hub is the member that meets most others over all buckets, any of those that tie: the original among its
    edited copies. A bucket of k members yields k - 1 pairs. Aggregates are written before they are joined with what they
    come from, so that the joins meet plain exchanges, which Spark splits where a bucket skews them.
    """
    sizes = table(members.groupBy("bucket").agg(F.count("*").alias("size")), "sizes")
    sized = table(members.join(small(sizes, NARROW), "bucket"), "sized")
    fame = table(sized.groupBy("id").agg(F.sum("size").alias("fame")), "fame")
    hubs = table(sized.join(small(fame, NARROW), "id").groupBy("bucket").agg(F.max_by("id", "fame").alias("hub")), "hubs")
    members = table(sized.join(small(hubs, NARROW), "bucket"), "hubs")
    return members, members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


class Judge(NamedTuple):
    """What decides about the pairs of a block.

    read: rows of signatures and the buckets that each was posted to, out of some signatures; every similar pair shares a
    bucket, and agrees in at least `limit` places of its signatures. decode: the sorted distinct codes of each blob.
    percent: pairs are similar with 100 * intersection >= percent * union.
    """

    read: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    decode: Callable[[list[bytes]], list[np.ndarray]]
    limit: int
    percent: int


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, label): members other than the hub of buckets that hold several components. labels: (id, label) of linked ids."""
    labelled = table(members.where("size > 2").join(small(labels, NARROW), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    several = table(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"), "several")
    return table(labelled.join(small(several, NARROW), "bucket", "left_semi").where("id <> hub").select("bucket", "id", "label"), "open")


def border_links(rest: DataFrame, signs: DataFrame, blobs: Callable[[DataFrame], DataFrame], judge: Judge, block: int = 2048, size: int = 8 << 20) -> DataFrame:
    """Distinct links (a, b) between components, out of open_members(). signs: (id, sign); blobs: ids to (id, blob), the
    whole sets of some ids.

    Signatures alone are compared first, in blocks of a bucket; only members that may be similar to one of another
    component have their sets fetched, are dealt to blocks of bounded bytes and compared exactly. Every two blocks of a
    bucket meet in one place, which keeps its own union-find and gives back only links that join two of its components:
    fewer than it has members. A bucket of up to `block` members is sent once, as signatures.
    """
    likely = _meeting(rest.join(signs, "id"), ["sign"], _dealt(rest.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks"))))
    names = "bucket long, id long, label long"
    found = table(likely.mapInArrow(tidy(_by_block(likely.columns, lambda ids, label, apart, bucket, sign: _wanted(ids, label, apart, bucket, sign, judge), ["bucket", "id", "label"])), names).distinct(), "likely-members")
    held = table(blobs(table(found.select("id").distinct(), "likely-ids")), "blobs")
    weight = found.join(held.select("id", F.length("blob").alias("weight")), "id").groupBy("bucket")
    per = weight.agg(F.ceil(F.greatest(F.count("*") / (block // 2), F.sum("weight") / size)).alias("blocks"))
    exact = _meeting(found.join(signs, "id").join(held, "id"), ["sign", "blob"], _dealt(per))
    return exact.mapInArrow(tidy(_by_block(exact.columns, lambda ids, label, apart, bucket, sign, blob: _joining(ids, label, apart, bucket, sign, blob, judge), ["a", "b"])), "a long, b long").distinct()


def _dealt(per: DataFrame) -> DataFrame:
    """The number of blocks of each bucket (bucket, blocks), written so that joins on it can be split."""
    return small(table(per.select("bucket", F.col("blocks").cast("long")), "blocks"), NARROW)


def _meeting(rows: DataFrame, payload: list[str], per: DataFrame) -> DataFrame:
    """Rows (bucket, id, label, payload) dealt to the places (bucket, x, y) where blocks x and y meet; own is a row's block."""
    rows = rows.join(per, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "label", "own", *payload)
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "id")


def _by_block(columns: list[str], judge: Callable[..., np.ndarray], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls judge on the rows of each place and yields the rows of numbers that it gives."""
    payload = columns[6:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None:
                continue
            key = np.column_stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
            ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if batch is None:
                ends = np.append(ends, len(key))
            ids, label, own, lo = held["id"].to_numpy(), held["label"].to_numpy(), held["own"].to_numpy(), 0
            out = [np.zeros((0, len(names)), np.int64)]
            for hi in ends.tolist():
                mine = label[lo:hi]
                if hi - lo > 1 and (mine != mine[0]).any():
                    apart = own[lo:hi] if key[lo, 1] != key[lo, 2] else None
                    out.append(judge(ids[lo:hi], mine, apart, int(key[lo, 0]), *(held[c].slice(lo, hi - lo).to_pylist() for c in payload)))
                lo = hi
            held = held.slice(lo)
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names)

    return run


def _candidates(label: np.ndarray, apart: np.ndarray | None, bucket: int, matrix: np.ndarray, keys: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, k) of members of different labels (and, given apart, of different blocks) whose signatures agree
    often enough and that share no bucket before this one. Members are in the order of _ordered()."""
    n, i = len(label), 0
    ends = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n)
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    last = int(ends[-2]) if len(ends) > 1 else 0
    while i < last:
        start = int(stop[i])
        j = min(last, i + max(1, (16 << 20) // ((n - start) * matrix.shape[1])))
        same = (matrix[i:j, None] == matrix[None, start:]).sum(2) >= limit
        a, b = np.nonzero(same)
        a, b = a + i, b + start
        ok = b >= stop[a]
        if apart is not None:
            ok &= apart[a] != apart[b]
        a, b = a[ok], b[ok]
        shared = keys[a] == keys[b]
        ok = shared.any(1)
        a, b, first = a[ok], b[ok], shared.argmax(1)[ok]
        ok = keys[a, first] == bucket
        if ok.any():
            yield a[ok], b[ok]
        i = j


def _ordered(label: np.ndarray) -> np.ndarray:
    """An order of members by label, the largest label last: its members need no test with each other."""
    _, group, size = np.unique(label, return_inverse=True, return_counts=True)
    return np.lexsort((group, size[group]))


def _wanted(ids: np.ndarray, label: np.ndarray, apart: np.ndarray | None, bucket: int, sign: list[bytes], judge: Judge) -> np.ndarray:
    """(bucket, id, label) of the members of one place that have a candidate."""
    order = _ordered(label)
    matrix, keys = judge.read([sign[k] for k in order])
    wanted = np.zeros(len(ids), bool)
    for a, b in _candidates(label[order], None if apart is None else apart[order], bucket, matrix, keys, judge.limit):
        wanted[a] = wanted[b] = True
    at = order[wanted]
    return np.column_stack([np.full(len(at), bucket), ids[at], label[at]])


def _joining(ids: np.ndarray, label: np.ndarray, apart: np.ndarray | None, bucket: int, sign: list[bytes], blob: list[bytes], judge: Judge) -> np.ndarray:
    """Links (a, b) that join components of one place."""
    order = _ordered(label)
    ids, label = ids[order], label[order]
    matrix, keys = judge.read([sign[k] for k in order])
    some = list(_candidates(label, None if apart is None else apart[order], bucket, matrix, keys, judge.limit))
    if not some:
        return np.zeros((0, 2), np.int64)
    a, b = (np.concatenate(x) for x in zip(*some, strict=True))
    used, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = judge.decode([blob[order[k]] for k in used])
    x, y = both[: len(a)], both[len(a) :]
    n = np.array([len(s) for s in sets])
    if len(a) > 4 * len(sets):
        shared = intersections(sets)[x, y]
    else:
        shared = np.array([common(sets[i], sets[k]) for i, k in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    linked = (100 * shared >= judge.percent * (n[x] + n[y] - shared)) & (n[x] > 0)
    root: dict[int, int] = {}
    out = []

    def top(v: int) -> int:
        while (w := root.get(v, v)) != v:
            root[v] = v = root.get(w, w)
        return v

    for i, k in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        if (p := top(int(label[i]))) != (q := top(int(label[k]))):
            root[p] = q
            out.append((ids[i], ids[k]))
    return np.array(out, np.int64).reshape(-1, 2)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many codes every two of some sets of distinct codes share, exactly: codes that many sets hold by a product of
    0-1 matrices, some columns at a time, the others by their pairs. Below the diagonal it is the same as above."""
    n = len(sets)
    codes, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    count = np.diff(np.append(first, len(codes)))
    out, many = np.zeros((n, n), np.int64), max(8, n // 16)
    for c in np.unique(count[(count > 1) & (count < many)]).tolist():
        own = owner[first[count == c][:, None] + np.arange(c)]
        i, k = np.triu_indices(c, 1)
        for lo in range(0, len(own), max(1, (1 << 20) // len(i))):
            some = own[lo : lo + max(1, (1 << 20) // len(i))]
            out += np.bincount((some[:, i] * n + some[:, k]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    dense = np.flatnonzero(count >= many)
    for lo in range(0, len(dense), 1024):
        at = dense[lo : lo + 1024]
        x = np.zeros((n, len(at)), np.float32)
        column = np.repeat(np.arange(len(at)), count[at])
        x[owner[np.concatenate([np.arange(s, s + c) for s, c in zip(first[at].tolist(), count[at].tolist(), strict=True)])], column] = 1
        out += (x @ x.T).astype(np.int64)
    return out
