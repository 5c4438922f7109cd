"""Operators of tessera.llm against brute force on small fixtures: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, contamination, hashing, language, licenses, lines, near_dup, nearest, queries, substrings, urls

DOCS = "doc_id long, text string, component_id int, own string, label string"


def docs(spark, texts):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["w" + str(i) for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, " \n\t "), (None, " ".join(base)), (7, " ".join(rng.choice(words) for _ in range(30000)))]
    for i in range(40):
        some = list(base)
        for _ in range(rng.randrange(0, 7)):
            some[rng.randrange(len(some))] = rng.choice(words)
        out.append((100 + i, " ".join(some)))
    return out + [(100, out[7][1]), (300, "\n".join(["same line of text here, rather long"] * 3))]


def test_near_duplicates(spark, texts):
    found = near_dup.near_duplicates(docs(spark, texts)).collect()
    assert len(found) == len(texts)
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    known = [i for i in sets if i is not None]
    root = {i: i for i in known}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in known:
        for b in known:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (top(r["doc_id"]), len(sets[r["doc_id"]]), top(r["doc_id"]) == r["doc_id"])
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_substrings(spark, texts):
    length = 12
    words = [(t or "").split() for _, t in texts]
    seen = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    want = collections.Counter()
    for (i, _), w in zip(texts, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    found = substrings.remove(docs(spark, texts), length)
    assert collections.Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect())) == want
    assert substrings.remove(docs(spark, []), length).count() == 0


def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, f"{a}\n\nunique first"), (2, f"{a}!\n\nunique second"), (3, None), (4, ""), (None, a), (5, a), (5, a), (6, "x\nx")]
    found = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert found == {(1, f"{a}\n\nunique first", 0), (2, "\nunique second", 1), (3, None, 0), (4, "", 0), (None, a, 0), (5, "", 1), (6, "x", 1)}
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_bpe_round_trip(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    some = [*texts, (900, "a" * 3000), (901, "  two  spaces \n\n x y \r\n\t"), (902, "\U0001f389" * 200 + "<|endoftext|>")]
    for r in bpe.encoded(docs(spark, some), path, public_tokenizers.PATTERN).collect():
        text = next((t or "") for i, t in some if i == r["doc_id"])
        assert [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)] == own.encode_ordinary(text)
        assert r["decoded"].decode() == text


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": ["alpha", "anna", "abba"], "bb": ["bobbo", "bubbe", "tobb"]}
    made = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 10)]
    train = spark.createDataFrame([*made, (99, None, "aa"), (98, "alpha", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    ask = spark.createDataFrame([(1, "anna abba alpha"), (2, "tobb bubbe"), (3, None), (4, "12 !"), (5, ""), (6, "alpha anna abba " * 50 + "bobbo bubbe tobb " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(ask, model, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert 0.5 < got[6]["score"] < 0.8 and set(got[6]["mixture"]) == {"aa", "bb"}
    nothing = language.train(train.where("false"))
    assert {r["lang_pred"] for r in language.predict(ask, nothing, "doc_id").collect()} == {"und"}


def test_chat_trees(spark):
    odd = "</s>[INST] \\ <|end|>\n [/INST]"
    rows = [(1, 1, None, 0.0, "system", odd), (1, 2, 1, 1.0, "user", None), (1, 3, 1, 5.0, "user", "b"), (1, 4, 3, 0.0, "assistant", odd), (1, 5, 2, 1.0, "assistant", "c"), (2, 1, 9, 0.0, None, "x"), (3, 1, 2, 0.0, "user", "loop"), (3, 2, 1, 0.0, "user", "loop"), (None, 1, None, 0.0, "user", "z"), (2, 1, 9, 0.0, None, "x")]
    tree = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, node long, parent long, score double, role string, text string, leaf string")
    got = {r["conv_id"]: r for r in chat.conversations(tree).collect()}
    assert set(got) == {None, 1, 2} and got[1]["leaf"] == 4
    assert chat.read_turns(got[1]["formatted"]) == [("system", odd), ("user", "b"), ("assistant", odd)]
    assert [chat.unescape(got[1]["formatted"][s["start"] : s["end"]]) for s in got[1]["loss"]] == [odd]
    assert chat.conversations(tree, 2).count() == 4
    assert chat.conversations(tree.where("false")).count() == 0


def test_nearest(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, []), (1005, [1.0, 2.0])]
    rows += [(2000, rows[50][1]), (2001, rows[50][1])]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ok = {i: v for i, v in rows if v and len(v) == 8 and None not in v and any(v) and v[0] == v[0]}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    for q in (i for i in ok if i % 50 == 0):
        assert got[q] == sorted((i for i in ok if i != q), key=lambda i: (-round(cos(ok[q], ok[i]), 12), i))[:5]
    assert 1005 not in got and found.where("query_id = 1000").count() == 0


def test_licenses(spark):
    rows = [(1, "The MIT License. GNU General Public License"), (2, None), (3, ""), (4, "mit-license; licensed under the Apache License, Version 2.0"), (5, "SPDX-License-Identifier: BSD-3-Clause"), (6, "submit license")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"]) == (2, 1, 4, "gpl,mit", "gpl,mit")
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", 0.0)
    assert got[4]["base_labels"] == "apache,mit" and got[5]["labels"] == "bsd" and got[6]["labels"] == ""
    assert len(licenses.rules()) > 200


def test_contamination(spark):
    item = "If Tom has 5 apples and gives Mary 3 apples, then how many apples does Tom have after 5 days?"
    rows = [(1, "so: " + item.replace("Tom", "Anna").replace("5", "9").replace("Mary", "Paul")), (2, "If Anna has 9 apples and gives Paul 2 apples, then how many apples does Zoe have after 4 days?"), (3, None), (4, ""), (5, item), (6, "nothing of that kind is said here at all, is it"), (5, item)]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contamination.contaminated(docs(spark, rows), items).collect()}
    assert (1, 1) in got and (5, 1) in got and not {d for d, _ in got} & {3, 4, 6}
    assert got[(5, 1)]["verbatim"] and not got[(1, 1)]["verbatim"] and got[(1, 1)]["consistency"] == 1.0 and (2, 1) not in got
    assert contamination.contaminated(docs(spark, rows), items.where("false")).count() == 0
    assert contamination.contaminated(docs(spark, []), items).count() == 0


def test_urls(spark):
    day = lambda d: F.to_date(F.lit(d))
    entries = spark.createDataFrame([("block", "domain", "bad.com", "add", "2024-01-05", 1), ("block", "domain", "bad.com", "remove", "2024-01-10", 2)], "list string, kind string, key string, action string, day string, seq int").withColumn("day", F.to_date("day"))
    pages = spark.createDataFrame([(1, "http://x.bad.com/a"), (2, "http://notbad.com"), (3, None), (None, "junk"), (1, "http://x.bad.com/a")], "page_id long, url string")
    at = lambda d: sorted((r["verdict"] for r in urls.judge(pages.withColumn("fetched", day(d)), entries).collect()))
    assert at("2024-01-04") == ["allow"] * 5 and at("2024-01-05") == ["allow"] * 3 + ["block"] * 2 and at("2024-01-10") == ["allow"] * 5
    assert urls.judge(pages.withColumn("fetched", day("2024-01-05")), entries.where("false")).where("verdict = 'block'").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    kept = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(kept) <= 200 and all(len(r["ids_sha256"]) == 64 for r in kept)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_held_out_accuracy_and_url_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    found = queries.op4_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS FROM '{folder}/pages.parquet'")
    want = db.sql(queries.SQL["op3_url_filters"])
    got = queries.op3_url_filters(spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_digest_of_bpe_matches_plain_form(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = spark.createDataFrame([(1, "Hello, world!")], "doc_id long, text string")
    plain, digest = bpe.encoded(one, path, public_tokenizers.PATTERN).first(), bpe.digests(one, path, public_tokenizers.PATTERN).first()
    assert hashlib.sha256(plain["ids"]).hexdigest() == digest["ids_sha256"] and digest["n_tokens"] == len(plain["ids"]) // 4


def test_sorted_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50):
        x, y = (rng.integers(0, 40, n).astype(np.uint64) for _ in range(2))
        assert hashing.distinct(x).tolist() == sorted(set(x.tolist()))
        assert hashing.common(hashing.distinct(x), hashing.distinct(y)) == len(set(x.tolist()) & set(y.tolist()))


def test_line_members_across_tasks(spark):
    """Members of buckets equal those of a plain grouping, with lines of a bucket in one task and in several."""
    texts = [f"the common line number {i % 7} of all these lines here" for i in range(40)] + ["a line that nothing else is like", "", None, "x"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, own long").repartition(3)
    got = {(r["bucket"], r["id"]) for r in lines.members(lines.occurrences(docs, 5)).collect()}
    held = {}
    for t in {t for t in texts if t}:
        for b in lines.bands(lines.signatures([t]))[0].tolist():
            held.setdefault(b, set()).add(int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64)))
    assert got == {(b, i) for b, ids in held.items() if len(ids) > 1 for i in ids}
