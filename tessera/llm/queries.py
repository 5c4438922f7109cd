"""The registered queries of this subpackage: name to (spark, folder) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, contamination, language, licenses, lines, near_dup, nearest, substrings, urls


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.chains(turns.unionByName(more)))

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = chat.read_turns(formatted)
                learned = "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), _sha(whole), len(learned), _sha(learned), len(formatted)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return made.select("conv_id", "formatted", "loss").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The two best branches of trees made of the conversations: every third message replies to the one before the last, and
    a message's score is its length modulo 7."""
    chain = chat.chains(_read(spark, folder, "conversations"))
    parent = F.when(F.col("node") > 1, F.col("node") - F.when(F.col("node") % 3 == 0, 2).otherwise(1))
    tree = chain.withColumn("parent", parent).withColumn("score", (F.length(F.coalesce("text", F.lit(""))) % 7).cast("double"))
    made = chat.conversations(tree, 2)
    return made.select("conv_id", "leaf", "path_score", F.size(F.split("formatted", r"<\|turn\|>")).cast("long").alias("n_parts"), F.sha2(F.encode("formatted", "UTF-8"), 256).alias("formatted_sha256"))


_ESCAPED = "regexp_replace({}, '([\\\\<\\[])', '\\\\\\1', 'g')"
_TURNS = "SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS node FROM "
_FORMATTED = f"'{chat.TURN}' || {_ESCAPED.format('role')} || '{chat.TEXT}' || {_ESCAPED.format('text')} || '{chat.END.strip()}' || chr(10)"
_OP2_SQL = f"""
WITH turns AS ({_TURNS} (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY node)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY node) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_FORMATTED}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
_TREES_SQL = f"""
WITH RECURSIVE turns AS ({_TURNS} conversations),
tree AS MATERIALIZED (SELECT conv_id, node, CASE WHEN node > 1 THEN node - CASE WHEN node % 3 = 0 THEN 2 ELSE 1 END END AS parent, (length(text) % 7)::DOUBLE AS score, {_FORMATTED} AS part FROM turns),
walk(conv_id, node, path_score, n, formatted) AS (
  SELECT conv_id, node, score, 1, part FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.conv_id, t.node, w.path_score + t.score, w.n + 1, w.formatted || t.part FROM walk w JOIN tree t ON t.conv_id = w.conv_id AND t.parent = w.node),
leaves AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path_score DESC, node) AS rank FROM walk w WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.conv_id = w.conv_id AND t.parent = w.node))
SELECT conv_id, node AS leaf, path_score, (n + 1)::BIGINT AS n_parts, sha256(formatted) AS formatted_sha256 FROM leaves WHERE rank <= 2
"""


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: list, kind, key, action, day, seq: a dated block and allow list for the hosts of the test pages.
ENTRIES = [
    ("block-gambling", "domain", "casino-win.example.com", "add", "2024-01-10", 1),
    ("block-gambling", "domain", "casino-win.example.com", "remove", "2024-06-01", 2),
    ("block-gambling", "domain", "casino-win.example.com", "add", "2024-09-15", 3),
    ("block-spam", "host", "blog.tionsh.example.com", "add", "2024-02-01", 4),
    ("block-spam", "host", "blog.tionsh.example.com", "remove", "2024-05-01", 5),
    ("block-spam", "domain", "example.net", "add", "2024-07-01", 6),
    ("block-spam", "domain", "example.net", "remove", "2024-08-01", 7),
    ("block-spam", "path", "m.ththth.example.net/en", "add", "2024-03-01", 8),
    ("block-malware", "domain", "tionble.example.org", "add", "2024-04-01", 9),
    ("block-malware", "domain", "tionble.example.org", "remove", "2024-04-01", 10),
    ("block-malware", "domain", "tionble.example.org", "add", "2024-11-01", 11),
    ("allow-partners", "host", "tiontion.example.net", "add", "2024-07-10", 12),
    ("allow-partners", "host", "tiontion.example.net", "remove", "2024-07-20", 13),
]


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Pages bear no fetch time: each is taken as fetched on the day page_id mod 366 of 2024."""
    pages = _read(spark, folder, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(page_id % 366 AS INT))").alias("fetched"))
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, key string, action string, day string, seq int").withColumn("day", F.to_date("day"))
    return urls.judge(pages, entries).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


_OP3_SQL = f"""
WITH entry(list, kind, key, action, day, seq) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}', {f})" for a, b, c, d, e, f in ENTRIES)}),
last AS (SELECT list, kind, key, day, arg_max(action, seq) AS action FROM entry GROUP BY ALL),
page AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1) AS path FROM pages),
hit AS (
  SELECT p.page_id, k.list FROM page p, (SELECT DISTINCT list, kind, key FROM entry) k
  WHERE CASE k.kind WHEN 'host' THEN p.host = k.key WHEN 'domain' THEN p.host = k.key OR p.host LIKE '%.' || k.key
    ELSE p.host || '/' || p.path = k.key OR p.host || '/' || p.path LIKE k.key || '/%' END
  AND (SELECT arg_max(l.action, l.day) FROM last l WHERE l.list = k.list AND l.kind = k.kind AND l.key = k.key AND l.day <= p.fetched) = 'add'),
names AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hit GROUP BY page_id)
SELECT page_id, url, strftime(fetched, '%Y-%m-%d') AS fetched, host, coalesce(lists, '') AS lists,
  CASE WHEN lists LIKE '%allow%' OR lists IS NULL THEN 'allow' ELSE 'block' END AS verdict
FROM page LEFT JOIN names USING (page_id)
"""


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    model = language.train(docs.where("NOT held_out"))
    return language.predict(docs, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, folder, "documents"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("text"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, other) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM reach r JOIN e ON e.x = r.other),
least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
"""


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(_read(spark, folder, "documents"), 35, digest=True)


_OP6_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
every AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS code FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
spots AS MATERIALIZED (SELECT r, i, code FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM every) WHERE n > 1),
doubled(length, r, i, code) AS (
  SELECT 35::BIGINT, r, i, code FROM spots
  UNION ALL SELECT length, r, i, code FROM (
    SELECT *, count(*) OVER (PARTITION BY code) AS n FROM (SELECT 2 * a.length AS length, a.r, a.i, md5(a.code || b.code) AS code FROM doubled a JOIN doubled b ON a.r = b.r AND b.i = a.i + a.length)) WHERE n > 1),
longest AS (SELECT r, max(length) AS longest FROM doubled GROUP BY r),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
judged AS (SELECT w.r, w.i, word, coalesce(max(s.i) OVER (PARTITION BY w.r ORDER BY w.i) > w.i - 35, false) AS gone FROM words w LEFT JOIN spots s ON s.r = w.r AND s.i = w.i),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0) AS longest
FROM d LEFT JOIN kept USING (r) LEFT JOIN longest USING (r)
"""


def op7_approximate_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_read(spark, folder, "documents"))


def op9_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its id, lines, lines that go, and the digest of the text that is left (null for a null text)."""
    kept = lines.dedup_lines(_read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_OP10_SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
node AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM l WHERE NOT regexp_full_match(line, '\\s*'))),
s AS MATERIALIZED (SELECT DISTINCT id, {_LOW.format("substring(line, k, 8)")} AS shingle FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 7, 1) + 1)) AS k FROM node)),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, other) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM reach r JOIN e ON e.x = r.other),
least AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
judged AS (SELECT l.doc_id, l.i, l.line, node.id IS NOT NULL AND row_number() OVER (PARTITION BY coalesce(label, node.id) ORDER BY l.doc_id, l.i) > 1 AS gone FROM l LEFT JOIN node USING (line) LEFT JOIN least USING (id)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_chat_formatting,
        chat_reply_trees,
        op3_url_filters,
        op4_language_id,
        op5_minhash_near_dedup,
        op6_substring_dedup,
        op7_approximate_nearest_neighbours,
        op8_license_scans,
        op9_byte_level_bpe,
        op10_line_dedup,
    )
}
SQL: dict[str, str] = {
    "op2_chat_formatting": _OP2_SQL,
    "chat_reply_trees": _TREES_SQL,
    "op3_url_filters": _OP3_SQL,
    "op5_minhash_near_dedup": _OP5_SQL,
    "op6_substring_dedup": _OP6_SQL,
    "op10_line_dedup": _OP10_SQL,
}
