"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows, no rows and clashing names; language ID too."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language

#: Columns of documents, and others that stages and operators use themselves.
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, LANG_PRED int, mixture int, n_removed int, n_lines string, __gone int, __own string, __leak int, component_id int, kept boolean, hash string, own string"
OTHER = ("s", 1, 2, 3, "l", 4, "o", 5, 6, True, "h", "w")
STAGES = dict(corpus_pipeline.STAGES)
ITEM = "which of these seven rivers of the northern plain is the longest of them all"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), *OTHER) for i, t, lang in rows], KIND)


def words(seed, n, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def kept(spark, folder, name, rows):
    docs = table(spark, rows)
    out = STAGES[name](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    found = out.collect()
    assert all(tuple(r)[5:] == OTHER for r in found) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
    assert STAGES[name](spark, docs.where("false"), folder).count() == 0
    return sorted(((r["doc_id"], r["text"]) for r in found), key=repr)


def test_identify(spark, folder):
    a, b = words(1, 50), words(2, 50, "klmnopqrst")
    long = words(3, 40_000)
    rows = [(i, words(10 + i, 30), "a") for i in range(5)] + [(10 + i, words(20 + i, 30, "klmnopqrst"), "b") for i in range(5)]
    rows += [(20, a, None), (None, b, None), (21, None, "a"), (22, "", "b"), (23, "12 34 !", None), (24, long, None), (20, a, None)]
    want = [(i, t) for i, t, _ in rows if i not in (21, 22, 23)]
    assert kept(spark, folder, "language_id", rows) == sorted(want, key=repr)
    assert STAGES["language_id"](spark, table(spark, [(1, a, None)]), folder).count() == 0  # nothing learned


def test_dedup_lines(spark, folder):
    a, b = words(1, 12), words(2, 12)
    rows = [(3, f"{a}\n{b}", "x"), (1, a, "x"), (None, a, "x"), (4, None, "x"), (5, "", "x"), (6, " \n", "x"), (7, f"{a.upper()}!", "x"), (8, "y\n" + words(5, 30_000), "x"), (1, a, "x")]
    want = [(3, b), (1, a), (1, a), (None, a), (4, None), (5, ""), (6, " \n"), (8, rows[7][1])]
    assert kept(spark, folder, "line_dedup", rows) == sorted(want, key=repr)


def test_dedup_documents(spark, folder):
    a, b, long = words(1, 80), words(2, 80), words(3, 30_000)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(2, a, "x"), (1, near, "x"), (None, a, "x"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (5, " \t", "x"), (6, b, "x"), (6, b, "x"), (7, long, "x"), (8, long.upper(), "x"), (9, "one", "x"), (10, "ONE", "x")]
    want = [(1, near), (None, a), (3, None), (3, None), (4, ""), (5, " \t"), (6, b), (7, long), (9, "one")]
    assert kept(spark, folder, "near_dedup", rows) == sorted(want, key=repr)


def test_decontaminate(spark, folder):
    inside = f"{words(1, 20)} {ITEM} {words(2, 20)}"
    rows = [(1, inside, "x"), (1, words(4, 30), "x"), (None, inside, "x"), (2, None, "x"), (3, "", "x"), (4, words(3, 30_000), "x"), (5, f"{words(3, 30_000)} {ITEM}", "x"), (6, "the longest of them all", "x"), (7, inside, "x"), (7, inside, "x")]
    want = [(1, rows[1][1]), (2, None), (3, ""), (4, rows[5][1]), (6, rows[7][1])]
    assert kept(spark, folder, "decontamination", rows) == sorted(want, key=repr)


def test_encode(spark, folder):
    docs = table(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", "x"), (3, words(1, 20_000), "x")])
    found = STAGES["byte_bpe"](spark, docs, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {(r["doc_id"], r["decoded_sha256"]): r["n_tokens"] for r in found.collect()}
    assert found.count() == 5 and len(got) == 4 and sum(n == 0 for n in got.values()) == 2
    own = {(r["doc_id"], r["h"]) for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).collect()}
    assert set(got) == own and STAGES["byte_bpe"](spark, docs.where("false"), folder).count() == 0


def test_predict_names_and_no_rows(spark):
    docs = table(spark, [(1, words(1, 30), "a"), (2, words(2, 30, "klmnop"), "b")])
    model = language.train(docs)
    out = language.predict(docs, model, "doc_id", "score", "LANG_PRED")
    assert out.columns == ["doc_id", "score", "LANG_PRED", "lang_pred_", "score_", "mixture"]
    assert [(r["score"], r["LANG_PRED"], r["lang_pred_"]) for r in out.orderBy("doc_id").collect()] == [("s", 1, "a"), ("s", 1, "b")]
    assert language.predict(docs.where("false"), model, "doc_id").count() == 0 and language.train(docs.where("false")).languages == []
