"""Removal of passages that repeat anywhere in the corpus, by level-wise doubling.

A window is `length` consecutive words of one document; every word covered by a window whose word sequence also starts
anywhere else is removed. Windows that repeat at one length alone are extended to twice that length:

1. Level length/2. In every window, the half-length span of least fingerprint (leftmost of equals) is its seed: equal
   windows have equal seeds at equal places, so only seeds, about one in ten positions, need counting. A window whose
   seed occurs once is unique and goes no further.
2. Level length, where the seed recurs. All windows of one seed form a run, at most length - length/2 + 1 of them. If
   every run of a seed is whole found again (same words, same place of the seed), all windows of those runs repeat;
3. the other runs of such seeds are cut into single windows, whose fingerprints are counted.

Then the same at twice that length, four times, ..., until no candidates survive: a window of 2 * length words is a
candidate only where its two halves both repeat, so each level works on what the one before has left, in the documents
that it has left. The first level decides what is removed, since a word covered by a repeated longer window is covered by a
repeated shorter one; the last that a document reaches is the length of its longest repeated passage, to a factor of two.

Fingerprints that decide are 128 bits (two of 64 that differ in their constants). A passage in a third of all documents
is one key: counts are aggregated before the shuffle, and joins on it are plain ones, which Spark splits.

Defined results: a null or empty text has no words; a document shorter than the window keeps all; a text of any length is
read whole, a few megabytes of the batch at a time; repeated rows are copies and lose all covered words, as any copies do;
rows with equal doc_id, a null one included, but other text are told apart by the text's hash; other columns are ignored,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import Words, batches, buffers, prefix, spans, words
from tessera.llm.support import columns, forget, table, tidy

#: Bytes of text that one task may hold with the fingerprints of all its words: some 200 MB, 600 where words are single letters.
TOGETHER = 8 << 20


def leftmost_least(codes: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` codes, the place of its least code, the leftmost of equals."""
    at, reach = np.arange(len(codes)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at, reach = np.where(codes[left] <= codes[right], left, right), reach + step
    return at


def runs(found: Words, length: int, seed: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Per run of windows with one seed: row, first window, number of windows, seed's fingerprint, two of the whole run.
    allowed, by word, says which windows are candidates; by default all are."""
    first = np.concatenate([np.arange(lo, hi - length + 1) for lo, hi in zip(found.rows[:-1], found.rows[1:], strict=True) if hi - lo >= length] or [np.zeros(0, np.int64)])
    if allowed is not None:
        first = first[allowed[first]]
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    codes = found.windows(seed)
    at = leftmost_least(codes, length - seed + 1)[first]
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    start, place = first[begin], at[begin]
    whole = [spans(prefix(found.codes, s), start, length - 1 + count, s) + (place - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (0, 1)]
    row = np.searchsorted(found.rows, start, "right") - 1
    return row, start - found.rows[row], count, codes[place].view(np.int64), whole[0].view(np.int64), whole[1].view(np.int64)


def _listed(spots: pa.Scalar, words: int) -> np.ndarray:
    """Whether a window listed in spots (first, n) starts at each word."""
    edge = np.zeros(words + 1, np.int64)
    first, n = (spots.values.field(k).to_numpy() for k in range(2))
    ok = first < words
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, np.minimum(first + n, words)[ok], -1)
    return np.cumsum(edge[:-1]) > 0


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, own, first, n, seed, w1, w2): a row for every run of docs (doc_id, text, own). Where docs has spots as well,
    the repeated windows of half the length, only windows whose halves are both among them count."""
    wide = "spots" in docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo, hi, found in batches(batch.column(1)):
                allowed = None
                if wide:
                    allowed = np.zeros(int(found.rows[-1]), bool)
                    for i in range(lo, hi):
                        a, b = found.rows[i - lo], found.rows[i - lo + 1]
                        mine = _listed(batch.column(3)[i], int(b - a))
                        half = length // 2
                        allowed[a : max(a, b - half)] = mine[: max(0, b - a - half)] & mine[half:]
                row, first, n, code, w1, w2 = runs(found, length, seed, allowed)
                ids = (c.slice(lo, hi - lo).take(pa.array(row)) for c in (batch.column(0), batch.column(2)))
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x) for x in (first, n, code, w1, w2))], ["doc_id", "own", "first", "n", "seed", "w1", "w2"])

    return docs.select("doc_id", "text", "own", *["spots"] * wide).mapInArrow(tidy(run), "doc_id long, own long, first long, n long, seed long, w1 long, w2 long")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, own, first, w1, w2): every window of the runs that docs (doc_id, text, own, runs) lists."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column(3)
            for lo, hi, found in batches(batch.column(1)):
                row, first = [], []
                for i in range(lo, hi):
                    spots = lists[i].values
                    a, n = (spots.field(k).to_numpy() for k in range(2))
                    own = np.unique(np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    own = own[own + length <= found.rows[i - lo + 1] - found.rows[i - lo]]  # rows that share an id may differ in length
                    row.append(np.full(len(own), i))
                    first.append(own)
                row, first = np.concatenate(row), np.concatenate(first)
                start = first + found.rows[row - lo]
                codes = [spans(prefix(found.codes, s), start, length, s).view(np.int64) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(first), *(pa.array(c) for c in codes)], ["doc_id", "own", "first", "w1", "w2"])

    return docs.mapInArrow(tidy(run), "doc_id long, own long, first long, w1 long, w2 long")


KEY = ["doc_id", "own"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own): own tells rows apart that share a doc_id but not the text."""
    return columns(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))


def _of(docs: DataFrame, found: DataFrame, how: str, *names: str) -> DataFrame:
    """docs (doc_id, text, own) joined with columns of found (doc_id, own, ...); null ids are equal."""
    other = found.select(F.col("doc_id").alias("d"), F.col("own").alias("o"), *names)
    return docs.join(other, (docs["own"] == other["o"]) & docs["doc_id"].eqNullSafe(other["d"]), how).select("doc_id", "text", "own", *names)


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, own, spots): per row of keyed() docs the runs of windows (first window, number) that occur elsewhere too; a
    table. With a column spots, as _seeds() takes it, only those candidates are looked at."""
    found = table(_seeds(docs, length, -(-length // 2)), "seeds")
    whole = found.groupBy("seed", "w1", "w2").agg(F.count("*").alias("n"))
    fate = whole.groupBy("seed").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    fate = table(fate, "fate")  # so that the join below meets plain exchanges, which Spark splits where skewed
    alive = table(found.join(fate.select("seed", "least"), "seed").select(*KEY, "first", "n", (F.col("least") > 1).alias("whole")), "alive")
    alike = docs.groupBy(*KEY).count().where("count > 1").limit(1).count()
    listed = (F.collect_set if alike else F.collect_list)(F.struct("first", "n"))  # rows alike in id and text name the same windows; sets cost more
    forget(found)
    open_ = table(alive.where("NOT whole").groupBy(*KEY).agg(listed.alias("runs")), "runs")
    single = table(_windows(_of(docs, open_, "inner", "runs"), length), "windows")
    twice = table(single.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"), "twice")
    hits = single.join(twice, ["w1", "w2"], "left_semi").select(*KEY, "first", F.lit(1).cast("long").alias("n"))
    every = alive.where("whole").select(*KEY, "first", "n").unionByName(hits)
    out = table(every.groupBy(*KEY).agg(listed.alias("spots")), "repeats")
    for done in (fate, alive, open_, single, twice):
        forget(done)
    return out


def _further(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, own, longest): the levels from length on, in one task, over keyed texts with spots, the repeated windows of
    half that length; only of rows that reach one."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names) for b in rows] or [pa.RecordBatch.from_pylist([], schema)])
        found = words(*buffers(held["text"]))
        size = np.diff(found.rows)
        end, longest, now = np.repeat(found.rows[1:], size), np.zeros(held.num_rows, np.int64), length
        again = np.concatenate([np.zeros(0, bool), *(_listed(x, n) for x, n in zip(held["spots"], size.tolist(), strict=True))])
        sums = [prefix(found.codes, s) for s in (0, 1)]
        while True:
            at = np.flatnonzero(again)
            at = at[at + now <= end[at]]
            at = at[again[at + now // 2]]
            w1, w2 = (spans(sums[s], at, now, s) for s in (0, 1))
            order = np.lexsort((w2, w1))
            same = np.flatnonzero((w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]]))
            if not len(same):
                break
            again = np.zeros(len(again), bool)
            again[at[order[same]]] = again[at[order[same + 1]]] = True
            longest[np.searchsorted(found.rows, np.flatnonzero(again), "right") - 1] = now
            now *= 2
        reached = pa.array(np.flatnonzero(longest))
        yield pa.RecordBatch.from_arrays([*(held[c].combine_chunks().take(reached) for c in KEY), pa.array(longest[longest > 0])], [*KEY, "longest"])

    names = [*KEY, "text", "spots"]
    spot = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("text", pa.string()), ("spots", spot)])
    return texts.select(*names).coalesce(1).mapInArrow(tidy(run), "doc_id long, own long, longest long")


def levels(docs: DataFrame, length: int = 35, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Tables of keyed() docs: repeated() at length, and (doc_id, own, longest), the greatest of 2 * length, 4 * length, ...
    at which a window of the document still repeats. Each level reads what survived the one before, the last ones together
    where that is at most so many bytes of text."""
    first = last = repeated(docs, length)
    out, now, texts = [first.select(*KEY, F.lit(length).cast("long").alias("longest"))], length, docs
    while True:
        reach = F.array_max(F.transform("spots", lambda s: s["first"] + s["n"])) - F.array_min(F.transform("spots", lambda s: s["first"]))
        texts = table(_of(texts.select(*docs.columns), last.where(reach > now), "inner", "spots"), "survivors")  # the others have no two windows `now` words apart
        now *= 2
        if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= together:
            out.append(_further(texts, now))
            break
        last = repeated(texts, now)
        if not last.limit(1).count():
            break
        out.append(last.select(*KEY, F.lit(now).cast("long").alias("longest")))
    return first, table(reduce(DataFrame.unionByName, out).groupBy(*KEY).agg(F.max("longest").alias("longest")), "longest")


def _covered(spots: pa.Scalar | None, words: int, length: int) -> np.ndarray:
    """Which words the listed windows cover."""
    edge = np.zeros(words + 1, np.int64)
    if spots is not None and spots.is_valid:
        first, n = (spots.values.field(k).to_numpy() for k in range(2))
        ok = first < words
        np.add.at(edge, first[ok], 1)
        np.add.at(edge, np.minimum(first + n + length - 1, words)[ok], -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, length: int = 35, digest: bool = False, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, longest) per row of docs (doc_id, text): the kept words joined by one space, or
    with digest, as kept_sha256, the hex digest of that string in UTF-8; and the longest repeated length by levels(), or 0."""
    docs = keyed(docs)
    spots, longest = levels(docs, length, together)
    both = spots.join(longest.select(F.col("doc_id").alias("d"), F.col("own").alias("o"), "longest"), (F.col("own") == F.col("o")) & F.col("doc_id").eqNullSafe(F.col("d")))
    joined = _of(docs, both, "left", "spots", "longest").select("doc_id", "text", "spots", F.coalesce("longest", F.lit(0)).alias("longest"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            total, gone, kept = [], [], []
            for text, where in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if where.is_valid:
                    out = _covered(where, len(words), length)
                    left = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    left = words
                total.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), batch.column(3)], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept", "longest"]
    return joined.mapInArrow(tidy(run), f"doc_id long, n_words long, n_removed long, {names[3]} string, longest long")
