"""A corpus pipeline: documents in, token digests out.

Each stage takes (spark, docs, folder), works on all that the one before kept, and its decisions take effect: language ID
drops documents of no identified language, line dedup removes repeated lines (and documents that lose every word of
theirs), near-dedup keeps one document of each group, decontamination drops documents that hold a benchmark item, and BPE
encodes what is left. All but the last return the columns of documents; n_chars, where present, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, language, lines, near_dup
from tessera.llm.support import NARROW, free, small, table

#: Of the languages found in a document, the largest must hold at least this share.
SHARE = 0.5
#: Documents whose shingle sets have at least this Jaccard similarity, in percent, are near copies. (op5 asks for 85.)
PERCENT = 80


def identify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with an identified main language; learned from the labelled ones among docs.

    A null text, one without letters, and any text where no row has a label are rejected; so is a text of which no language
    holds SHARE. Rows that repeat are judged alike; ties go to the first language by name. Columns pass unchanged, whatever
    their names; no rows give no rows.
    """
    found = language.predict(docs, language.train(docs), *(docs[c] for c in docs.columns))
    return found.where((F.col(free(docs, "lang_pred")) != "und") & (F.col(free(docs, "score")) >= SHARE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts of lines that stay; a document whose lines all went goes too.

    Of a line that repeats, the first by (doc_id, line number) stays. Null and empty texts, and rows with a null doc_id,
    stay as they are; rows that repeat lose the same lines. n_chars, where present, follows the text; other columns pass
    unchanged, whatever their names; no rows give no rows.
    """
    out = lines.dedup_lines(docs).where((F.col(free(docs, "n_removed")) == 0) | F.col("text").rlike("\\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id.

    Null texts, texts without words and rows with a null doc_id all stay. Rows that share a doc_id are one document and stay
    or go together; of rows that are alike in doc_id and text, one stays. Columns pass unchanged, whatever their names; no
    rows give no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, key = (plain[names[docs.columns.index(c)]] for c in ("text", "doc_id"))
    found = table(near_dup.near_duplicates(docs, percent=PERCENT).select("doc_id", "kept"), "found")
    gone = table(found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    left = plain.join(small(gone, NARROW), key == gone["__gone"], "left_anti")
    twice = table(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__twice")), "twice")
    if twice.limit(1).count():
        again = left.join(small(twice, NARROW), key == twice["__twice"], "left").withColumn("__own", F.when(F.col("__twice").isNotNull() & text.isNotNull(), F.xxhash64(text)))
        once = again.where("__own IS NOT NULL").dropDuplicates(["__twice", "__own"])
        left = again.where("__own IS NULL").unionByName(once).select(*names)
    return left.toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts hold none; rows that repeat go together; of rows that share a doc_id only those go whose own text
    holds an item, a null doc_id included. Columns pass unchanged, whatever their names; no rows give no rows, and with no
    items all stay.
    """
    return contamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document.

    A null or empty text has no ids and the digests of nothing; a null doc_id stays null; rows that repeat are encoded
    alike; other columns are left out; no rows give no rows.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", decontaminate), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
