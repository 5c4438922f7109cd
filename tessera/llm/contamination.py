"""Benchmark decontamination by template windows; DataFrame functions only.

A text is canonicalised: a word with a digit becomes a number placeholder, a unit after a number a unit placeholder, a
capitalised word inside a sentence, or after a number or unit, a name placeholder; punctuation goes and letters are lower-cased. Benchmark items that
share a template are one, under their smallest id. Every window of WINDOW canonical words of a document is looked up by
hash among all item windows, which gives alignments of a document with an item.
Windows of fewer than LITERALS literal words say too little as a template; they are looked up by their words as they
stand, values included, and such an alignment counts only words that are the same as they stand. Aligned documents are read again: an alignment's coverage is the share of the item's canonical
words that the document has at the same places, and its consistency the share of slots where the document's value is the
one that the item's value is mostly replaced by: a re-parameterised question replaces a value alike everywhere. Where
words were put in or left out, an item lies at several shifts: each alignment is measured alone and once more with the
item's runs of RUN words that the document has elsewhere up to an item's length away, and passes either way. A run of
PASSAGE words of the item with its values makes a document contaminated whatever share of the item it is.

Defined results: null or empty texts and items match nothing; an item of fewer than WINDOW words is one window of its own
length; of several alignments with one item that pass the best stays, ties to the first; repeated rows are one; rows with a null
doc_id are reported under null; of rows that share a doc_id but not the text, clean() drops those that hold an item, rows
with a null doc_id included; a text of any length is one row of windows; other columns are ignored, or pass through clean()
unchanged whatever their names; no documents or no items give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.support import NARROW, columns, small, table

WINDOW, LITERALS = 8, 3
COVERAGE, CONSISTENCY = 0.5, 0.75
RUN, PASSAGE = 4, 13
#: Bytes of Parquet files up to which item windows and templates are broadcast; in memory they are some ten times as large.
WIDE = 16 << 20
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
UNITS = "km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|yards?|kg|g|mg|grams?|pounds?|lbs?|ounces?|tons?|l|ml|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|mph|kmh|dollars?|cents?|euros?|percent|degrees?|watts?|volts?|joules?|newtons?|hertz|bytes?"


def canonical(text: Column) -> Column:
    """The canonical words of a text, as many as it has words with a letter or digit."""
    x = F.regexp_replace(text, "[\ue000-\ue002]", "")
    x = F.when(x.rlike(r"\p{N}"), F.regexp_replace(x, r"(?<!\S)[^\s\p{N}]*+\p{N}\S*", NUMBER)).otherwise(x)
    x = F.when(F.contains(x, F.lit(NUMBER)), F.regexp_replace(x, rf"(?<={NUMBER}\s)(?i:{UNITS})(?=[\s\p{{P}}]|$)", UNIT)).otherwise(x)
    x = F.regexp_replace(x, "\\p{Lu}(?<=[\\p{Ll},;\ue000\ue001] \\p{Lu})\\p{Ll}*+(?!\\p{L})", NAME)
    x = F.regexp_replace(F.lower(x), "[^\\p{L}\\p{M}\\s\ue000-\ue002]+", "")
    return F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")


def surface(text: Column) -> Column:
    """The words that canonical() stands for, in order."""
    return F.filter(F.split(F.regexp_replace(text, "[\ue000-\ue002]", ""), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{M}\p{N}]"))


def plain(values: Column) -> Column:
    """Words of surface() in lower case, without the punctuation around them."""
    return F.transform(values, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")))


def _windows(words: Column, length: int) -> Column:
    """(place, hash) of the windows of this length."""
    places = F.sequence(F.lit(0), F.size(words) - length, F.lit(1))
    made = F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(words, i + 1, length)).alias("hash")))
    return F.when(F.size(words) >= length, made)


def templates(items: DataFrame) -> DataFrame:
    """(item_id, words, values, variants): one row per distinct template of items (item_id, text); values are those of the
    first item, variants the distinct plain() ones of all."""
    known = columns(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    made = known.withColumn("words", canonical(F.col("text"))).where("words[0] <> ''")
    one = made.groupBy("words").agg(F.min(F.struct("item_id", "text")).alias("first"), F.collect_set(plain(surface(F.col("text")))).alias("variants"))
    return one.select(F.col("first.item_id").alias("item_id"), "words", surface(F.col("first.text")).alias("values"), "variants")


def _literal(words: Column, place: Column) -> Column:
    """How many literal words the window at a place has."""
    return F.size(F.filter(F.slice(words, place + 1, WINDOW), lambda w: ~w.isin(NUMBER, UNIT, NAME)))


def _few_literals(known: DataFrame, lengths: list[int]) -> tuple[DataFrame, list[int]]:
    """(item_id, at, hash, variant) of the windows of few literal words of each variant of templates(), a table, hashed over
    the variant's words; and which of these lengths such windows have."""
    each = known.select("item_id", "words", F.posexplode("variants").alias("variant", "plain"))
    made = []
    for n in lengths:
        of = each.where(F.least(F.size("words"), F.lit(WINDOW)) == n).select("item_id", "variant", "words", F.explode(_windows(F.col("plain"), n)).alias("w"))
        few = of.where(_literal(F.col("words"), F.col("w.place")) < F.least(F.lit(LITERALS), F.size("words")))
        made.append(few.select("item_id", F.col("w.place").alias("at"), F.col("w.hash").alias("hash"), "variant", F.lit(n).alias("n")))
    exact = table(reduce(DataFrame.unionByName, made), "exact-windows")
    return exact.drop("n"), sorted(r[0] for r in exact.select("n").distinct().collect())


def _aligned(words: DataFrame, mine: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct (doc_id, own, item_id, shift, variant) of windows of words (doc_id, own, words) that are among mine."""
    every = F.concat(*(F.coalesce(_windows(F.col("words"), n), F.array().cast("array<struct<place:int,hash:bigint>>")) for n in lengths)) if len(lengths) > 1 else _windows(F.col("words"), lengths[0])
    found = words.select("doc_id", "own", F.explode(every).alias("w")).select("doc_id", "own", F.col("w.place").alias("place"), F.col("w.hash").alias("hash")).join(small(mine, size=WIDE), "hash")
    return found.select("doc_id", "own", "item_id", (F.col("place") - F.col("at")).alias("shift"), "variant").distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, n_slots, consistency, verbatim): documents that hold an item or a variant of it."""
    return best(_passing(docs, items)).select("doc_id", "item_id", *_NAMES)


def _passing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, own, item_id, shift) and the measures of all alignments that pass; own is the hash of the text."""
    docs = columns(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))
    known = table(templates(items), "templates")
    lengths = sorted(r[0] for r in known.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW values
    if not lengths:
        return docs.crossJoin(known.select("item_id")).select("doc_id", "own", "item_id", F.lit(0).alias("shift"), *_measures()).where("false")
    mine = reduce(DataFrame.unionByName, [known.where(F.least(F.size("words"), F.lit(WINDOW)) == n).select("item_id", F.explode(_windows(F.col("words"), n)).alias("w"), "words") for n in lengths])
    mine = table(mine.where(_literal(F.col("words"), F.col("w.place")) >= F.least(F.lit(LITERALS), F.size("words"))).select("item_id", F.col("w.place").alias("at"), F.col("w.hash").alias("hash"), F.lit(None).cast("int").alias("variant")), "item-windows")
    aligned = _aligned(docs.select("doc_id", "own", canonical(F.col("text")).alias("words")), mine, lengths)
    exact, lengths = _few_literals(known, lengths)
    if lengths:
        aligned = aligned.unionByName(_aligned(docs.select("doc_id", "own", plain(surface(F.col("text"))).alias("words")), exact, lengths))
    aligned = table(aligned, "alignments")
    again = docs.dropDuplicates(["doc_id", "own"]).join(small(table(aligned.select(F.col("own").alias("o")).distinct(), "aligned")), F.col("own") == F.col("o"), "left_semi")
    read = table(again.select(F.col("doc_id").alias("d"), F.col("own").alias("o"), canonical(F.col("text")).alias("words"), surface(F.col("text")).alias("values")), "aligned-words")
    both = aligned.join(read, (aligned["own"] == read["o"]) & aligned["doc_id"].eqNullSafe(read["d"])).drop("d", "o")
    both = both.join(small(known, size=WIDE).select(F.col("item_id"), F.col("words").alias("item_words"), F.col("values").alias("item_values"), "variants"), "item_id")
    return measures(both).select("doc_id", "own", "item_id", "shift", *_NAMES)


_NAMES = ["coverage", "n_slots", "consistency", "verbatim"]


def _measures() -> list[Column]:
    return [F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_slots"), F.lit(0.0).alias("consistency"), F.lit(True).alias("verbatim")]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _elsewhere(here: Column, places: Column) -> Column:
    """The places of `here`, and for item words that have none those in the first equal run of RUN words, at least two of
    them literal, that the document has up to an item's length before the alignment or after it."""
    n = F.size("item_words")
    begin = F.greatest(F.lit(0), F.col("shift") - n)
    region = F.slice("words", begin + 1, F.col("shift") + 2 * n - begin)
    hashes = lambda words: F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(0), F.size(words) - RUN), lambda i: F.xxhash64(F.slice(words, i + 1, RUN))))
    literal = lambda j: F.size(F.filter(F.slice("item_words", j + 1, RUN), lambda w: ~w.isin(NUMBER, UNIT, NAME))) >= 2
    found = lambda near: F.transform(hashes(F.col("item_words")), lambda h, j: F.when(literal(j), F.nullif(F.array_position(near, h), F.lit(0)) - 1 + begin))
    place = lambda runs, i: F.coalesce(F.get(here, i), *(F.get(runs, i - d) + d for d in range(RUN)))
    return _let(_let(_let(region, hashes), found), lambda runs: F.transform(places, lambda i: place(runs, i).cast("int")))


def _passage(places: Column) -> Column:
    """The most words in a row that the document has at this shift as an item of the template has them, values included."""
    longer = lambda a, same: F.when(same, a["now"] + 1).otherwise(0)
    step = lambda a, same: F.struct(longer(a, same).alias("now"), F.greatest(a["most"], longer(a, same)).alias("most"))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    run = lambda mine, item: F.aggregate(places, none, lambda a, i: step(a, F.get(mine, i) == F.get(item, i)), lambda a: a["most"])
    return _let(plain(F.transform(places, lambda i: F.get("values", i + F.col("shift")))), lambda mine: F.array_max(F.transform("variants", lambda item: run(mine, item))))


def measures(both: DataFrame) -> DataFrame:
    """Alignments that pass, with their measures."""
    n = F.size("item_words")
    places = F.sequence(F.lit(0), n - 1)
    same = F.transform(places, lambda i: F.when(F.get("words", i + F.col("shift")).eqNullSafe(F.get("item_words", i)), i + F.col("shift")))  # null outside the document
    stands = F.transform(places, lambda i: F.get("values", i + F.col("shift")))
    stands = _let(plain(stands), lambda mine: _let(F.get("variants", F.col("variant")), lambda item: F.transform(places, lambda i: F.when(F.get(mine, i) == F.get(item, i), i + F.col("shift")))))
    same = F.when(F.col("variant").isNull(), same).otherwise(stands)
    ways = _let(same, lambda here: F.when(F.col("variant").isNotNull() | F.forall(here, lambda p: p.isNotNull()), F.array(here)).otherwise(F.array_distinct(F.array(here, _elsewhere(here, places)))))
    each = both.withColumn("passage", _passage(places)).withColumn("at", F.explode(ways))  # the document's place of each item word, or null
    each = each.withColumn("coverage", F.size(F.filter("at", lambda p: p.isNotNull())) / n).where((F.col("coverage") >= COVERAGE) | (F.col("passage") >= PASSAGE))
    slots = F.filter(places, lambda i: F.get("at", i).isNotNull() & F.get("item_words", i).isin(NUMBER, UNIT, NAME))
    measured = each.withColumn("pairs", F.transform(slots, lambda i: F.struct(F.when(F.col("variant").isNull(), F.get("item_values", i)).otherwise(F.get("values", F.get("at", i))).alias("x"), F.get("values", F.get("at", i)).alias("y"))))
    # The share of an item's value that goes to its most frequent replacement, over all values: counts within one item.
    tops = F.transform(
        F.array_distinct(F.transform("pairs", lambda p: p["x"])),
        lambda x: F.array_max(F.transform(F.array_distinct(F.filter("pairs", lambda p: p["x"] == x)), lambda q: F.size(F.filter("pairs", lambda p: p == q)))),
    )
    agreed = F.aggregate(tops, F.lit(0), lambda a, b: a + b)
    measured = measured.withColumn("n_slots", F.size("pairs").cast("long")).withColumn("consistency", F.when(F.size("pairs") == 0, 1.0).otherwise(agreed / F.greatest(F.size("pairs"), F.lit(1))))
    measured = measured.withColumn("verbatim", F.forall(places, lambda i: F.get("at", i).eqNullSafe(i + F.col("shift"))) & F.forall("pairs", lambda p: p["x"] == p["y"]))
    return measured.where(((F.col("coverage") >= COVERAGE) & (F.col("consistency") >= CONSISTENCY)) | (F.col("passage") >= PASSAGE))


def best(passing: DataFrame) -> DataFrame:
    """The best alignment of each (doc_id, item_id)."""
    order = F.struct("coverage", "consistency", (-F.abs("shift")).alias("near"), "shift", "n_slots", "verbatim")
    return passing.groupBy("doc_id", "item_id").agg(F.max(order).alias("m")).select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows, which are known by doc_id, null or not, and text."""
    leaks = table(_passing(docs, items).select(F.col("doc_id").alias("__leak"), F.col("own").alias("__own")).distinct(), "leaks")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, key = (plain[names[docs.columns.index(c)]] for c in ("text", "doc_id"))
    return plain.join(small(leaks, NARROW), (F.xxhash64(own) == leaks["__own"]) & key.eqNullSafe(leaks["__leak"]), "left_anti").toDF(*docs.columns)
