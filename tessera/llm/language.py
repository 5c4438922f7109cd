"""Language identification as multilingual mixture inference.

Training counts byte trigrams (letters of a-z lower-cased, other ASCII bytes as one space) per language over all labelled
rows, pre-aggregated per task; the model is a table of languages x BUCKETS smoothed probabilities. For a document,
expectation-maximisation estimates the proportions of languages whose mixture best explains its trigrams; languages are
then taken in order of their share as long as each raises the likelihood by more than its penalty.

Defined results: `und` with score 0 for a null text, one without letters, or when nothing was learned; else the language
of the largest share, ties to the first by name, and its share as score. Rows with a null label or text teach nothing;
repeated rows count each time; a text of any length is read whole; other columns are ignored, and where one that is kept
has the name of a column that is added, that one gets an underscore behind its name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashing import buffers
from tessera.llm.support import columns, free, tidy

BUCKETS = 1 << 15
#: More languages than this raise an error: the model must fit the driver and each task.
LANGUAGES = 500

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of one text, which a space precedes and follows; those of spaces alone are left out."""
    x = np.full(len(data) + 2, 32, np.uint32)
    x[1:-1] = _FOLD[data]
    codes = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    codes = codes[codes != 0x202020]
    return (codes * np.uint32(2654435761)) >> np.uint32(17)


@dataclass(frozen=True)
class Model:
    """Languages in order of name and their trigram probabilities, one row each."""

    languages: list[str]
    chances: np.ndarray


def train(docs: DataFrame) -> Model:
    """Learns from all rows of docs (text, lang)."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in rows:
            data, offsets = buffers(batch.column(0))
            for i, lang in enumerate(batch.column(1).to_pylist()):
                found = np.bincount(grams(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BUCKETS)
        n[rows["bucket"]] = rows["n"]
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [n.tobytes()]})

    known = columns(docs, "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.mapInArrow(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").applyInPandas(pack, "lang string, counts binary").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"]) for r in found]).reshape(-1, BUCKETS) + 0.05
    return Model([r["lang"] for r in found], counts / counts.sum(axis=1, keepdims=True))


def shares(chances: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation, and the log-likelihood that they reach."""
    total, part = n.sum(), np.full(len(chances), 1 / len(chances))
    for _ in range(rounds if len(chances) > 1 else 0):
        part = part * (chances @ (n / (part @ chances))) / total
    return part, float(n @ np.log(part @ chances))


def mixture(model: Model, found: np.ndarray, penalty: float = 3.0) -> dict[int, float]:
    """The selected languages of a text (by index) and their proportions."""
    n = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(n)
    n, chances = n[at].astype(float), model.chances[:, at]
    order = np.argsort(-shares(chances, n)[0], kind="stable")
    best, part = shares(chances[order[:1]], n)[1], np.ones(1)
    for k in range(2, len(order) + 1):
        now, reached = shares(chances[order[:k]], n)
        if reached - best <= penalty * np.log(len(found)):
            break
        best, part = reached, now
    return dict(zip(order[: len(part)].tolist(), part.tolist(), strict=True))


def predict(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """Per row of docs (text): the columns in keep, then lang_pred, score and mixture (language to proportion; see free())."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    names_made = [free(kept, n) for n in ("lang_pred", "score", "mixture")]
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    width = len(kept.columns)
    names_kept = [f"c{i}" for i in range(width)]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names_kept, kept.schema, strict=True)), *made])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows:
            texts = batch.column(width)
            data, offsets = buffers(texts)
            names, score, mixed = [], [], []
            for i in range(batch.num_rows):
                part: dict[str, float] = {}
                own = data[offsets[i] : offsets[i + 1]]
                if model.languages and lettered(texts[i].as_py()):
                    part = {model.languages[k]: v for k, v in mixture(model, grams(own)).items()}
                top = min(part, key=lambda k: (-part[k], k), default="und")
                names.append(top)
                score.append(min(1.0, part.get(top, 0.0)))
                mixed.append(list(part.items()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                [*names_kept, "lang_pred", "score", "mixture"],
            )

    return docs.select(*keep, docs["text"]).toDF(*names_kept, "text").mapInArrow(tidy(run), schema).toDF(*kept.columns, *names_made)


def lettered(text: str | None) -> bool:
    """Whether any character is a letter."""
    return text is not None and any(map(str.isalpha, text))
