"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five lower-cased words. Every register holds an exponentially spaced,
truncated minimum of hashed exponential variates (Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog",
2021): registers of a union are the maxima of its parts' registers, and two registers agree with a probability that
follows the Jaccard similarity. Steps, each a DataFrame job over written tables:

1. one row per document: set size, 128-bit digest of the set, registers;
2. documents with equal digests form a class, which its smallest id represents: copies cost one row each from there on;
3. bands of registers post representatives to buckets; in each bucket all are paired with one hub, the member that
   meets most others, so a bucket of k members yields k - 1 pairs;
4. pairs pass if the likelihood of both registers gives a similarity near the threshold, then both texts are read and
   their whole sets compared;
5. buckets whose members fall into several components after step 4 are gone through block by block: members whose
   registers agree often enough over a component's border have their sets fetched and compared in the block, which gives
   back only links that join components;
6. union-find over links between representatives, and classes joined back.

At J = 0.85, 32 bands of 8 registers miss a pair with probability 2e-5. Below that threshold the same registers are dealt
out a second time, in another order, into 32 more bands: at J = 0.8, where 32 bands miss about 2e-3. Defined results: a null text or one without
words has an empty set and is linked with nothing; a text of one to four words has its whole sequence as one shingle; a
text of any length is read whole, a few megabytes of the batch at a time; ties between hubs go to any; repeated rows are
copies; rows with equal doc_id are one document, which is linked by each of its texts; a null doc_id takes no part, its
component is null and it is kept; other columns of the input are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import Words, batches, common, distinct, mix
from tessera.llm.linking import Judge, border_links, crowded, hub_pairs, open_members
from tessera.llm.support import NARROW, columns, components, small, table, tidy


@dataclass(frozen=True)
class SetSketch:
    """Registers of sets of 64-bit codes.

    base: ratio of neighbouring register values; rate: of the exponential variates; limit: largest register value.
    """

    registers: int = 256
    base: float = 1.2
    rate: float = 20.0
    limit: int = 254

    def factors(self) -> np.ndarray:
        return (mix(np.arange(1, self.registers + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def minima(self, codes: np.ndarray) -> np.ndarray:
        """The least 32-bit hash under each register's function."""
        short, by = (codes >> np.uint64(32)).astype(np.uint32), self.factors()[:, None]
        out = np.full(self.registers, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), 1024):
            np.minimum(out, (short[None, i : i + 1024] * by).min(axis=1), out=out)
        return out

    def values(self, minima: np.ndarray) -> np.ndarray:
        """floor(1 - log_base x) of the exponential variate x that a minimum stands for, truncated to 0..limit."""
        x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(self.base)), 0, self.limit).astype(np.uint8)

    def jaccard(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity of row pairs of registers, given both set sizes."""
        more, less = (a > b).sum(1), (a < b).sum(1)
        u = n_a / (n_a + n_b)
        v, step = 1 - u, np.log(self.base)
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (self.base - 1) / self.base) / step
        lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

        def likelihood(j: np.ndarray) -> np.ndarray:
            x, y = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
            return more * np.log(x) + less * np.log(y) + (self.registers - more - less) * np.log(np.maximum(1 - x - y, 1e-12))

        for _ in range(24):  # the likelihood is concave: golden-section search
            x, y = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
            up = likelihood(x) < likelihood(y)
            lo, hi = np.where(up, x, lo), np.where(up, hi, y)
        return (lo + hi) / 2


SKETCH = SetSketch()


def merge(*registers: np.ndarray) -> np.ndarray:
    """Registers of the union of sets, out of the registers of each."""
    return np.maximum.reduce(registers)


def sets(found: Words, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle codes."""
    windows = found.windows(k)
    for lo, hi in zip(found.rows[:-1], found.rows[1:], strict=True):
        n = hi - lo
        if n >= k:
            yield distinct(windows[lo : hi - k + 1])
        elif n:
            yield Words(found.data, found.starts, found.ends, found.codes[lo:hi], found.rows).windows(int(n), 1)
        else:
            yield windows[:0]


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, registers) of every row; the last three are null for empty sets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0)
            for lo, hi, found in batches(batch.column(1), lower=True):
                size, low = [], np.full((hi - lo, SKETCH.registers), 0xFFFFFFFF, np.uint32)
                digest = np.zeros((hi - lo, 2), np.int64)
                for i, s in enumerate(sets(found, k)):
                    size.append(len(s))
                    if len(s):
                        low[i] = SKETCH.minima(s)
                        digest[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                empty = np.array(size) == 0
                flat = pa.py_buffer(np.ascontiguousarray(SKETCH.values(low)))
                registers = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH.registers), hi - lo, [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(digest[:, 0], mask=empty), pa.array(digest[:, 1], mask=empty), pa.array(registers.to_pylist(), pa.binary(), mask=empty)],
                    ["doc_id", "n_shingles", "d1", "d2", "registers"],
                )

    return columns(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, registers binary")


def band_keys(bands: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Buckets of bands of registers, given as 64-bit numbers, by the bands' numbers."""
    return mix(bands + mix(number.astype(np.uint64) + np.uint64(1)))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union; empty ones never do."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def banded(registers: np.ndarray, percent: int) -> np.ndarray:
    """Bands of 8 registers as 64-bit numbers, by rows of registers; under 85 percent also those of the transposed registers."""
    n = len(registers)
    once = np.ascontiguousarray(registers).view(np.uint64)
    if percent >= 85:
        return once
    return np.hstack([once, np.ascontiguousarray(registers.reshape(n, -1, 8).transpose(0, 2, 1)).reshape(n, -1).view(np.uint64)])


def bound(percent: int) -> float:
    """The least estimated similarity of a pair that is worth a test: five standard deviations of the estimate below the threshold."""
    t = percent / 100
    return t - max(0.11, 5 * (t * (1 - t) / SKETCH.registers) ** 0.5)


def least_agreeing(percent: int) -> int:
    """How many registers of a similar pair agree at least: four standard deviations below their number at the threshold."""
    p = 1 + 2 * np.log1p(-(1 - percent / 100) / 2 * (SKETCH.base - 1) / SKETCH.base) / np.log(SKETCH.base)
    return int(SKETCH.registers * p - 4 * (SKETCH.registers * p * (1 - p)) ** 0.5)


def judge(percent: int) -> Judge:
    """For border_links(): signatures are registers, blobs the codes of whole sets."""

    def read(signs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        registers = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), SKETCH.registers)
        bands = banded(registers, percent)
        return registers, band_keys(bands, np.arange(bands.shape[1])[None, :]).view(np.int64)

    return Judge(read, lambda blobs: [np.frombuffer(x, np.uint64) for x in blobs], least_agreeing(percent), percent)


def postings(reps: DataFrame, percent: int) -> DataFrame:
    """(bucket, id) for every band of registers."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            bands = banded(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, SKETCH.registers), percent)
            n = bands.shape[1]
            keys = band_keys(bands, np.arange(n)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["bucket", "id"])

    return reps.select("id", "registers").mapInArrow(tidy(run), "bucket long, id long")


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose registers' likelihood gives at least this similarity."""
    one = reps.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = reps.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            matrix = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)  # noqa: E731, B023
            keep = pa.array(SKETCH.jaccard(matrix(2), matrix(4), batch.column(3).to_numpy(), batch.column(5).to_numpy()) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "na", "rb", "nb").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held: list[list[np.ndarray]] = [[], []]
            a, b = batch.column(2), batch.column(3)
            keep, i = np.zeros(batch.num_rows, bool), 0
            while i < batch.num_rows:  # a few rows at a time: texts may be long
                n = min(16, batch.num_rows - i)
                for side, column in enumerate((a, b)):
                    held[side] = [s for _, _, found in batches(column.slice(i, n), lower=True) for s in sets(found, k)]
                for j, (x, y) in enumerate(zip(*held, strict=True)):
                    keep[i + j] = similar(x, y, percent)
                i += n
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    wanted = table(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "paired")
    texts = texts_of(docs, wanted)
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): the distinct texts of these ids."""
    some = columns(docs, "doc_id", "text").withColumnRenamed("doc_id", "id").join(small(ids, NARROW), "id", "left_semi")
    return some.withColumn("own", F.xxhash64("text")).dropDuplicates(["id", "own"]).select("id", "text")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, blob): the codes of the set of every text of these ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo, hi, found in batches(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets(found, k)], pa.binary())], ["id", "blob"])

    return texts_of(docs, ids).mapInArrow(tidy(run), "id long, blob binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text); see the module's text."""
    least = bound(percent)
    known = table(sketches(docs, k), "sketches")
    full = known.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    # Where rows share a doc_id, it may stand for several classes and so have several rows of registers.
    reps = table(full.join(classes, ["d1", "d2"]).where("doc_id = id").dropDuplicates(["id", "d1", "d2"]).select("id", "registers", F.col("n_shingles").alias("n")), "representatives")
    members, pairs = hub_pairs(crowded(postings(reps, percent)))
    pairs = table(likely(pairs, reps, least).distinct(), "likely")
    links = table(verified(pairs, docs, k, percent), "verified")
    # Ids of one class, or of several where rows share a doc_id, hang together too.
    labels = table(components(links), "labels")
    rest = open_members(members, labels)
    signs = reps.select("id", F.col("registers").alias("sign")).join(small(table(rest.select("id").distinct(), "open-ids"), NARROW), "id", "left_semi")
    links = links.unionByName(table(border_links(rest, signs, lambda ids: whole_sets(docs, ids, k), judge(percent)), "border"))
    shared = full.join(classes, ["d1", "d2"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(links.unionByName(_ambiguous(shared, classes)))
    tied = known.join(classes, ["d1", "d2"], "left")
    of_class = F.coalesce(F.col("label"), F.col("class_id"), F.col("doc_id"))
    tied = tied.withColumnRenamed("id", "class_id").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(of_class)
    return tied.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ambiguous(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Class links (doc_id, representative) of ids that stand in several classes, which happens only where rows share a
    doc_id: those with several other representatives, and those that represent a class themselves."""
    several = shared.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    return shared.join(several, "a", "left_semi").unionByName(shared.join(classes.select(F.col("id").alias("a")).distinct(), "a", "left_semi"))
