"""Removal of lines that repeat, exactly or nearly, anywhere in the corpus.

Lines are what newlines separate. Equal lines have equal 64-bit hashes and are one node from the start; a second hash
tells apart lines of which only the first is equal, so 128 bits decide that a line repeats. A line's set is its
distinct shingles of SHINGLE characters (A-Z lower-cased; a shorter line is one shingle), its signature ROWS * BANDS
MinHash values, which post it to BANDS buckets; at a similarity of 0.8 a pair is missed with probability 0.002. Bucket
members are paired with the bucket's hub, whole shingle sets are compared, union-find joins what is linked, and buckets
that still hold several components are gone through block by block (see linking). Of each component the line that comes
first by (doc_id, line number) stays; all other occurrences go.

Defined results: blank lines (of white space alone) take no part and stay; a null text stays null; rows with equal doc_id
and text are one document given twice and treated alike; of rows with equal doc_id but other texts the one of the smaller
hash comes first; rows with a null doc_id take no part and stay whole; a text of any length is read whole, a few million
characters of the batch at a time; a document that loses all its lines is left with an empty text, or its blank lines;
other columns pass unchanged, and where one has the name of a column that is added, that one gets an underscore behind
its name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashing import distinct, mix
from tessera.llm.linking import Judge, border_links, hub_pairs, open_members
from tessera.llm.near_dup import similar
from tessera.llm.support import NARROW, columns, components, forget, free, merged, small, table, tidy

SHINGLE, ROWS, BANDS, LIKELY = 8, 4, 12, 27
#: Tells the second hash of a line from the first.
CHECK = 7
_FACTORS = (mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALTS = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))


def _laid(lines: list[str], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A polynomial over every SHINGLE characters of the lines laid end to end, and where each line's shingles start and stop."""
    n = np.maximum([len(x) for x in lines], SHINGLE)
    text = "\n".join([x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines])
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    x[(x >= 65) & (x <= 90)] += kind(32)
    code, base = x[: len(x) - SHINGLE + 1].copy(), kind(0x9E3779B97F4A7C15 >> (64 - 8 * x.itemsize) | 1)
    for j in range(1, SHINGLE):
        code *= base
        code += x[j : j + len(code)]
    starts = np.cumsum(n + 1) - n - 1
    return code, starts, starts + n - SHINGLE + 1


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of all lines' shingles, and where each line's start and stop; what lies between lines means nothing."""
    code, starts, stops = _laid(lines, np.uint64)
    return mix(code), starts, stops


def _short(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with 32-bit codes, mixed as MurmurHash3 does: enough for signatures, which are verified."""
    x, starts, stops = _laid(lines, np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x, starts, stops


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's sorted distinct shingle codes."""
    if not lines:
        return []
    codes, starts, stops = shingles(lines)
    return [distinct(codes[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def signatures(lines: list[str]) -> np.ndarray:
    """ROWS * BANDS MinHash values of each line."""
    out, lo = np.empty((len(lines), ROWS * BANDS), np.uint32), 0
    while lo < len(lines):
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size < 100_000):  # characters at a time, to stay in cache
            size += len(lines[hi])
            hi += 1
        codes, starts, stops = _short(lines[lo:hi])
        short = np.append(codes, np.uint32(0xFFFFFFFF))
        at, hashed = np.column_stack([starts, stops]).ravel(), np.empty_like(short)
        for k, f in enumerate(_FACTORS):
            np.multiply(short, f, out=hashed)
            out[lo:hi, k] = np.minimum.reduceat(hashed, at)[::2]
        lo = hi
    return out


def bands(signs: np.ndarray) -> np.ndarray:
    """The buckets of signatures, a row each: even numbers, so that postings() has a bit for itself."""
    pairs = np.ascontiguousarray(signs).view(np.uint64).reshape(len(signs), BANDS, ROWS // 2)
    code = np.broadcast_to(_SALTS, (len(signs), BANDS))
    for j in range(ROWS // 2):
        code = mix(code ^ pairs[:, :, j])
    return (code & ~np.uint64(1)).view(np.int64)


_FOUND = pa.schema([("id", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()), ("line", pa.int32()), ("bucket", pa.int64()), ("part", pa.int32()), ("posts", pa.binary())])


def _rows(n: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _FOUND], schema=_FOUND)


def _posted(ids: np.ndarray, buckets: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Postings of distinct lines: one of each bucket, packed by ranges of buckets, and all others of it as members."""
    bucket, n = buckets.ravel().view(np.uint64), buckets.size
    order = np.argsort(bucket)
    bucket, line = bucket[order], ids[order // BANDS]
    first = np.ones(n, bool)
    first[1:] = bucket[1:] != bucket[:-1]
    at, rest = np.flatnonzero(first), np.flatnonzero(~first)
    met = np.diff(np.append(at, n)) > 1
    if len(rest):
        yield _rows(len(rest), id=pa.array(line[rest].view(np.int64)), bucket=pa.array(bucket[rest].view(np.int64)))
    posts = np.column_stack([bucket[at] | met.astype(np.uint64), line[at]])
    cut = np.searchsorted((posts[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cut))
    offsets = (np.append(cut[used], len(posts)) * 16).astype(np.int32)
    yield _rows(len(used), part=pa.array(used.astype(np.int32)), posts=pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets), pa.py_buffer(posts)]))


def parts(docs: DataFrame) -> int:
    """Ranges of buckets: four a shuffle partition, and one per 64 MB of input at least, where its size is known."""
    held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = held >> 26 if held < 1 << 60 else 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known, 1 << 21))


def occurrences(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of three kinds. (id, check, doc_id, own, line): a line that takes part. (bucket, id): a member of a bucket that is known
    to hold several lines. (part, posts): postings of a task's distinct lines to a range of buckets, one a bucket, as pairs of
    64-bit numbers: the bucket, plus one where the task has members of it, and the line's id.

    So a bucket, however many lines it holds, has no more postings than the tasks have had runs of 150,000 lines.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        salt = xxh64_intdigest(CHECK.to_bytes(8, "little"), 42)
        seen: set[int] = set()
        fresh: list[int] = []
        held_bands: list[np.ndarray] = []
        for batch in chain(rows, [None]):
            lo = 0
            while batch is not None and lo < batch.num_rows:
                ids, checks, who, where, found, held = [], [], [], [], [], 0
                hi = lo
                while hi < batch.num_rows and (hi == lo or held < 4_000_000):  # characters at a time
                    text = batch.column(1)[hi].as_py() or ""
                    held += len(text)
                    for n, line in enumerate(text.split("\n")):
                        if not line or line.isspace():
                            continue
                        raw = line.encode("utf-8", "surrogatepass")
                        h = xxh64_intdigest(raw, 42)  # as Spark's xxhash64(text)
                        ids.append(h)
                        checks.append(xxh64_intdigest(raw, salt))  # as its xxhash64(CHECK, text)
                        who.append(hi)
                        where.append(n)
                        if h not in seen:
                            seen.add(h)
                            fresh.append(h)
                            found.append(line)
                    hi += 1
                lo = hi
                if found:
                    held_bands.append(bands(signatures(found)))
                who_ = pa.array(who, pa.int32())
                yield _rows(len(ids), id=pa.array(np.array(ids, np.uint64).view(np.int64)), check=pa.array(np.array(checks, np.uint64).view(np.int64)), doc_id=batch.column(0).take(who_), own=batch.column(2).take(who_), line=pa.array(where, pa.int32()))
            if fresh and (batch is None or len(fresh) > 150_000):
                yield from _posted(np.array(fresh, np.uint64), np.concatenate(held_bands), ranges)
                fresh, held_bands = [], []
                if len(seen) > 1_000_000:
                    seen.clear()

    types = "id long, check long, doc_id long, own long, line int, bucket long, part int, posts binary"
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "own").mapInArrow(tidy(run), types)


def members(found: DataFrame) -> DataFrame:
    """Distinct (bucket, id) of buckets that hold several lines, from occurrences()."""

    def buckets(blobs: list[bytes]) -> pa.RecordBatch:
        posts = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
        bucket = posts[:, 0] & ~np.uint64(1)
        order = np.argsort(bucket)
        bucket, met, line = bucket[order], posts[order, 0] & np.uint64(1), posts[order, 1]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        several = (np.maximum.reduceat(met, at) > 0) | (np.minimum.reduceat(line, at) != np.maximum.reduceat(line, at))
        keep = np.repeat(several, np.diff(np.append(at, len(line))))
        return pa.RecordBatch.from_arrays([pa.array(bucket[keep].view(np.int64)), pa.array(line[keep].view(np.int64))], ["bucket", "id"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in rows:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blobs:
                    yield buckets(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield buckets(blobs)

    packed = found.where("part IS NOT NULL").select("part", "posts").repartition("part").sortWithinPartitions("part")
    known = found.where("bucket IS NOT NULL").select("bucket", "id")
    return known.unionByName(packed.mapInArrow(tidy(run), "bucket long, id long")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lines whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 512):  # a line that several pairs share is read once
                part = batch.slice(at, 512)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = dict(zip(a, part.column(2).to_pylist(), strict=True)) | dict(zip(b, part.column(3).to_pylist(), strict=True))
                sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
                keep[at : at + 512] = [similar(sets[x], sets[y], percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(2)], ["a", "b"])

    one, two = (texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def judge(percent: int) -> Judge:
    """For border_links(): signatures are MinHash values, of which a similarity of 0.8 agrees in fewer than LIKELY places
    six times in 100,000; blobs are lines."""

    def read(signs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values = np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), -1)
        return values.astype(np.uint16), bands(values)

    def decode(lines: list[bytes]) -> list[np.ndarray]:
        out, lo = [], 0
        while lo < len(lines):
            hi, some, size = lo, [], 0
            while hi < len(lines) and (hi == lo or size < 500_000):  # bytes at a time
                some.append(lines[hi].decode("utf-8", "surrogatepass"))
                size += len(lines[hi])
                hi += 1
            out += shingle_sets(some)
            lo = hi
        return out

    return Judge(read, decode, LIKELY, percent)


def _signs(texts: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = signatures(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in made], pa.binary())], ["id", "sign"])

    return texts.select("id", "text").mapInArrow(tidy(run), "id long, sign binary")


def linked(docs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(id, check, label) of lines that are linked with others, from their occurrences()."""
    posted, pairs = hub_pairs(table(members(found), "members"))
    pairs = table(pairs, "pairs")
    wanted = table(posted.select("id").distinct(), "wanted")
    every = docs.where("doc_id IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("text")).withColumn("id", F.xxhash64("text"))
    texts = table(every.join(small(wanted, NARROW), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "lines")
    links = table(verified(pairs, texts, percent), "verified")
    labels = table(components(links), "labels")
    rest = open_members(posted, labels)
    of = lambda ids: texts.join(small(ids, NARROW), "id", "left_semi")
    signs = table(_signs(of(table(rest.select("id").distinct(), "open-ids"))), "signs")
    more = table(border_links(rest, signs, lambda ids: of(ids).select("id", F.encode("text", "UTF-8").alias("blob")), judge(percent)), "border")
    return merged(labels, more).join(texts.select("id", F.xxhash64(F.lit(CHECK).cast("long"), "text").alias("check")), "id")


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, own, gone): per document the numbers of the lines that go, in order; own is the xxhash64 of its text."""
    docs = columns(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))
    found = table(occurrences(docs, parts(docs)), "occurrences")
    labels = table(linked(docs, found, percent), "labels")
    # A line is (label, 0) if it is linked, else (id, check): 128 bits, so that no line goes for one that it merely shares a hash with.
    of = found.where("line IS NOT NULL").select("id", "check", "doc_id", "own", "line").join(small(labels, NARROW), ["id", "check"], "left")
    of = of.select(F.coalesce("label", "id").alias("label"), F.when(F.col("label").isNull(), F.col("check")).otherwise(0).alias("check"), "doc_id", "own", "line")
    line = ["label", "check"]
    several = table(of.groupBy(*line).agg(F.count("*").alias("n")).where("n > 1").select(*line), "several")
    of = table(of.join(small(several, NARROW), line), "occurring")
    forget(found)
    first = table(of.groupBy(*line).agg(F.min(F.struct("doc_id", "own", "line")).alias("first")), "first")
    gone = of.join(first, line).where(F.struct("doc_id", "own", "line") != F.col("first"))
    return gone.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with its own columns, texts rebuilt of the lines that stay, and two more: n_lines and n_removed (see free())."""
    lost = repeated_lines(docs, percent).select(F.col("doc_id").alias("__doc"), F.col("own").alias("__own"), F.col("gone").alias("__gone"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    plain = docs.toDF(*names)
    joined = plain.join(lost, (plain[names[key]] == lost["__doc"]) & (F.xxhash64(plain[names[at]]) == lost["__own"]), "left").drop("__doc", "__own")
    made = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)] + made)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in rows for i in range(0, b.num_rows, 500)):
            texts, total, removed = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                removed.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in out])
                texts.append(text)
            held = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays([*held, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return joined.mapInArrow(tidy(run), schema).toDF(*docs.columns, free(docs, "n_lines"), free(docs, "n_removed"))
