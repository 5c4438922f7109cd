"""Byte-level BPE by recursive SQL inside each partition.

A partition's texts are cut at single spaces between non-space characters, where no pre-token can span; each distinct
piece is cut into pre-tokens once, and pre-tokens not met before go to an in-process DuckDB. There a recursive query holds
one row per (word, position, token), which also names its right neighbour: every round joins neighbours with the merge
table, contracts each word's leftmost pair of least rank, and sets a word aside when no pair of it is in the table. Decoding joins ids with the
vocabulary and concatenates bytes by an ordered aggregate. Results are cached by piece, in a cache of bounded size, so
memory does not grow with the partition; nothing is shared between partitions but the vocabulary file.

A word of over CHUNK bytes would need a round per contraction, each over the whole word: it is cut into chunks, which are
contracted like other words, and joined by contracting again what lies about the cuts (see contract_long()).

Defined results: a null or empty text has no ids; special tokens do not exist; a text or word of any length is encoded
whole; repeated rows are encoded alike; other columns are ignored; no rows give no rows. Texts are cut into pieces by what
public_tokenizers.PATTERN does with white space; with another pattern they are not cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.support import columns, tidy

#: Bytes of a word that are contracted at once, under 512, as the query packs rank and position by 1024; longer words are
#: cut, and joined again where tokens allow it.
CHUNK = 32
#: Bytes and words that one recursive query takes, and pieces that a task keeps.
BYTES, WORDS, PIECES = 1_000_000, 30_000, 800_000

_ENCODE = """
WITH RECURSIVE state(word, pos, token, after, following, done) AS (
  SELECT word, pos, token, after, following, false FROM start
  UNION ALL
  SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.made ELSE s.token END, CASE WHEN s.pos = b.pos THEN b.after ELSE s.after END,
    CASE WHEN s.pos = b.pos THEN b.following WHEN s.after = b.pos THEN b.made ELSE s.following END, b.pos IS NULL
  FROM state s LEFT JOIN (
    SELECT x.word, x.best % 1024 AS pos, x.best // 1024 AS made, x.gone, y.after, y.following
    FROM (
      SELECT word, min(rank * 1024 + pos) AS best, arg_min(after, rank * 1024 + pos) AS gone
      FROM state JOIN merges ON pair = token * 1048576::BIGINT + following
      WHERE NOT done GROUP BY word
    ) x JOIN state y ON y.word = x.word AND y.pos = x.gone
  ) b ON s.word = b.word
  WHERE NOT s.done AND (b.gone IS NULL OR s.pos <> b.gone)
)
SELECT word, pos, token FROM state WHERE done
"""
#: The same for long stretches, which repeat themselves where they come here: a round contracts all pairs of least rank of
#: a word, every other one where they overlap, unless one of them would make a pair of lower rank, which would come first.
_ENCODE_ALL = """
WITH RECURSIVE state(word, pos, token, done) AS (
  SELECT word, pos, token, false FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN begins THEN best ELSE token END, best IS NULL
  FROM (
    SELECT *, coalesce(lag(begins) OVER w, false) AS ends
    FROM (
      SELECT * REPLACE (begins AND (NOT bool_or(rash) OVER (PARTITION BY word) OR pos = min(pos) FILTER (begins) OVER (PARTITION BY word)) AS begins)
      FROM (
        SELECT h.*, h.begins AND (coalesce(l.rank < best, false) OR coalesce(r.rank < best, false) OR coalesce(t.rank < best, false)) AS rash
        FROM (
          SELECT *, hit AND row_number() OVER (PARTITION BY word, island, hit ORDER BY pos) % 2 = 1 AS begins
          FROM (
            SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w AS island
            FROM (
              SELECT *, coalesce(rank = best, false) AS hit
              FROM (
                SELECT s.*, m.rank, min(m.rank) OVER (PARTITION BY word) AS best
                FROM (
                  SELECT word, pos, token, lag(token) OVER w AS before, lead(token) OVER w AS next, lead(token, 2) OVER w AS further
                  FROM state WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)
                ) s LEFT JOIN merges m ON m.pair = s.token * 1048576::BIGINT + s.next
              )
            ) WINDOW w AS (PARTITION BY word ORDER BY pos)
          )
        ) h
        LEFT JOIN merges l ON l.pair = h.before * 1048576::BIGINT + h.best
        LEFT JOIN merges r ON r.pair = h.best * 1048576::BIGINT + h.further
        LEFT JOIN merges t ON t.pair = h.best * 1048576::BIGINT + h.best
      )
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) WHERE NOT ends
)
SELECT word, pos, token FROM state WHERE done
"""
_DECODE = "SELECT seq, string_agg(v.hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary v USING (token) GROUP BY seq ORDER BY seq"


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


class Codec:
    """One task's encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.ids: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        joins = (x for z, rank in ranks.items() for k in range(1, len(z)) if z[:k] in ranks and z[k:] in ranks for x in (ranks[z[:k]], ranks[z[k:]], rank))
        left, right, rank = np.fromiter(joins, np.int64).reshape(-1, 3).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.register("pairs_in", pa.table({"pair": left * 1048576 + right, "rank": rank.astype(np.int32)}))
        self.db.execute("CREATE TABLE merges AS FROM pairs_in")
        self.db.register("vocabulary_in", pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": pa.array([z.hex() for z in ranks])}))
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary_in")

    def contract(self, words: list[bytes], query: str = _ENCODE) -> list[bytes]:
        """Ids of each word, by a recursive query; words of like length go together, as a round costs what is unfinished."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        sizes, order = np.cumsum(lengths), order.tolist()
        out = [b""] * len(words)
        lo = 0
        while lo < len(order):
            most = int(np.searchsorted(sizes, sizes[lo] - lengths[lo] + BYTES, "right"))
            hi = min(lo + WORDS, max(lo + 1, most))
            some = [words[k] for k in order[lo:hi]]
            n = lengths[lo:hi]
            ends = np.cumsum(n)
            word, token = np.repeat(np.arange(len(some), dtype=np.int32), n), self.single[np.frombuffer(b"".join(some), np.uint8)]
            pos = np.arange(len(token), dtype=np.int32) - (ends - n).astype(np.int32)[word]
            last = np.zeros(len(token), bool)
            last[ends - 1] = True
            self.db.register("start", pa.table({"word": word, "pos": pos, "token": token, "after": pa.array(pos + 1, mask=last), "following": pa.array(np.append(token[1:], 0).astype(np.int32), mask=last)}))
            found = self.db.sql(query).fetchnumpy()
            self.db.unregister("start")
            at = np.argsort((found["word"].astype(np.int64) << 32) + found["pos"])
            ids, stop = found["token"][at].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(found["word"], minlength=len(some)))).tolist()
            for k, a, b in zip(order[lo:hi], [0, *stop], stop, strict=False):
                out[k] = ids[a:b]
            lo = hi
        return out

    def contract_long(self, words: list[bytes]) -> list[bytes]:
        """The same for words of any length, whose chunks are contracted alone and then joined by twos.

        A sequence of tokens is what contraction gives of its bytes if and only if each two neighbours are what it gives of
        theirs: as long as nothing is contracted over any border between tokens, a token's own contractions come in the
        order that they have in it alone, and so the first one over a border would also come in the two neighbours alone.
        So where two parts meet, only tokens about the border are contracted again, further ones until the outermost of
        them stay as they are.
        """
        parts = [[w[i : i + CHUNK] for i in range(0, len(w), CHUNK)] for w in words]
        flat = iter(self.contract([x for p in parts for x in p]))
        held = [[_ids(next(flat)) for _ in p] for p in parts]
        while any(len(p) > 1 for p in held):
            pairs = [(p[k], p[k + 1]) for p in held for k in range(0, len(p) - 1, 2)]
            made = iter(self._joined(pairs))
            held = [[next(made) if k + 1 < len(p) else p[k] for k in range(0, len(p), 2)] for p in held]
        return [p[0].tobytes() for p in held]

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        out = [_ids(b"")] * len(pairs)
        reach, open_ = 2, list(range(len(pairs)))
        while open_:
            ends = [(pairs[k][0][-reach:], pairs[k][1][:reach]) for k in open_]
            texts = [b"".join([self.tokens[t] for t in [*a.tolist(), *b.tolist()]]) for a, b in ends]
            once = list(dict.fromkeys(texts))
            brief, wide = ([t for t in once if (len(t) > 2 * CHUNK) == long] for long in (False, True))
            ids = dict(zip(brief + wide, map(_ids, self.contract(brief) + self.contract(wide, _ENCODE_ALL)), strict=True))
            rest = []
            for k, (a, b), text in zip(open_, ends, texts, strict=True):
                x, y, new = *pairs[k], ids[text]
                if (len(a) == len(x) or new[0] == a[0]) and (len(b) == len(y) or new[-1] == b[-1]):
                    out[k] = np.concatenate([x[: len(x) - len(a)], new, y[len(b) :]])
                else:
                    rest.append(k)
            reach, open_ = 2 * reach, rest
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces not met before and decodes their ids again."""
        order = list(pieces)
        cuts = [[w.encode("utf-8", "surrogatepass") for w in self.cut(p)] for p in order]
        words = {w for ws in cuts for w in ws}
        ids = {w: self.ranks[w].to_bytes(4, "little") for w in words if w in self.ranks}
        rest = [w for w in words if w not in ids]
        long = [w for w in rest if len(w) > CHUNK]
        short = [w for w in rest if len(w) <= CHUNK] if long else rest
        ids |= zip(short, self.contract(short), strict=True)
        ids |= zip(long, self.contract_long(long), strict=True)
        whole = [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in cuts]
        self.ids.update(zip(order, whole, strict=True))
        self.back.update(zip(order, self.decode(whole), strict=True))

    def decode(self, sequences: list[bytes]) -> list[bytes]:
        """The bytes of sequences of little-endian ids."""
        out: list[bytes] = []
        for i in range(0, len(sequences), 4 * WORDS):
            some = sequences[i : i + 4 * WORDS]
            n = np.array([len(x) // 4 for x in some])
            if not n.sum():
                out += [b""] * len(some)
                continue
            seq = np.repeat(np.arange(len(some), dtype=np.int32), n)
            self.db.register("ids", pa.table({"seq": seq, "pos": np.arange(n.sum(), dtype=np.int32), "token": np.frombuffer(b"".join(some), "<u4").astype(np.int32)}))
            found = self.db.sql(_DECODE).fetchnumpy()
            self.db.unregister("ids")
            got = [b""] * len(some)
            for k, x in zip(found["seq"].tolist(), found["hex"].tolist(), strict=True):
                got[k] = bytes.fromhex(x)
            out += got
        return out


#: White space other than space and newline.
_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_AWKWARD = ("  ", " \n", "\n ", "\n\n", "\0", *_SPACES)


def _whole(text: str) -> list[str]:
    return [text] if text else []


def _split(text: str) -> list[str]:
    """Pieces that are pre-tokenised alike alone and in the text: cut before single spaces between non-space characters,
    and, where no white space meets other white space, around newlines."""
    if text[:1] != " " and text[-1:] != " " and not any(x in text for x in _AWKWARD):
        return [p for p in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if p]
    out: list[str] = []
    held: list[str] = []  # of a piece that white space still joins with the next
    for i, p in enumerate(text.split(" ")):
        p = f" {p}" if i else p
        if held and (p == " " or p[1:2].isspace() or held[-1][-1:].isspace()):
            held.append(p)
            continue
        if held:
            out.append("".join(held))
        held = [p]
    if held and (len(held) > 1 or held[0]):
        out.append("".join(held))
    return out


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as little-endian unsigned 32-bit integers, decoded as bytes read back from them."""
    return _run(docs, path, pattern, False)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, of what encoded() gives."""
    return _run(docs, path, pattern, True)


def _run(docs: DataFrame, path: str, pattern: str, digest: bool) -> DataFrame:
    """path is read where the tasks run: the vocabulary must lie there on every machine, as installed software does."""
    from public_tokenizers import PATTERN

    split = _split if pattern == PATTERN else _whole

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in rows:
            codec = codec or Codec(vocabulary(path), pattern)
            lo = 0
            while lo < batch.num_rows:
                texts, size, hi = [], 0, lo
                while hi < batch.num_rows and (hi == lo or size < 1_000_000):  # so many characters at a time
                    t = batch.column(1)[hi].as_py() or ""
                    texts.append(split(t))
                    size += len(t)
                    hi += 1
                if len(codec.ids) > PIECES:
                    codec.ids.clear()
                    codec.back.clear()
                new = set().union(*texts).difference(codec.ids)
                if new:
                    codec.learn(new)
                n, a, b = [], [], []
                for t in texts:
                    ids, back = b"".join(map(codec.ids.__getitem__, t)), b"".join(map(codec.back.__getitem__, t))
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                    b.append(hashlib.sha256(back).hexdigest() if digest else back)
                which = batch.column(0).slice(lo, hi - lo)
                if digest:
                    yield pa.RecordBatch.from_arrays([which, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([which, pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "ids", "decoded"])
                lo = hi

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary, decoded binary"
    return columns(docs, "doc_id", "text").mapInArrow(tidy(run), schema)
