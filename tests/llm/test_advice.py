"""What the review's findings ask for: each failed before its change."""

import numpy as np

from tessera.llm import contamination, near_dup


def test_pipeline_links_at_80_percent(spark):
    """Two texts of Jaccard similarity 106/126 = 0.841: one is left by the pipeline's stage, both by the operator at 85."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(120)]
    one, two = list(base), list(base)
    one[40], two[80] = "x", "y"
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, "quite another text")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [1, 3]
    assert near_dup.near_duplicates(docs).where("kept").count() == 3


def test_bands_at_80_percent():
    """Sets of similarity 0.8 share a band: 32 bands miss some 3 of these 2,000 pairs, 64 none."""
    rng = np.random.default_rng(7)
    missed = {80: 0, 85: 0}
    for _ in range(2000):
        both, x, y = np.split(rng.integers(0, 1 << 63, 360, dtype=np.uint64) * np.uint64(2), [288, 324])
        found = np.array([near_dup.SKETCH.values(near_dup.SKETCH.minima(np.concatenate([both, z]))) for z in (x, y)])
        for percent in missed:
            bands = near_dup.banded(found, percent)
            missed[percent] += not (bands[0] == bands[1]).any()
    assert missed[80] == 0 and missed[85] > 0
    assert near_dup.bound(80) < 0.8 - 5 * 0.0249 and near_dup.bound(85) < 0.74 + 1e-9


def _hits(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_copies_with_words_put_in_or_left_out(spark):
    """37 words in three shifts of 11 to 13 words, none of them half of the item."""
    item = [f"{chr(97 + i % 26)}{'xyz'[i // 26]}word" for i in range(37)]
    put_in = [*item[:12], "extra", *item[12:24], "more", "words", *item[24:]]
    left_out = [*item[:12], *item[13:24], *item[26:]]
    pieces = ["lead", *item[:9], *["other"] * 60, *item[20:28]]
    rows = [(1, " ".join(put_in)), (2, " ".join(["so", *left_out, "end"])), (3, " ".join(pieces)), (4, " ".join(item))]
    got = _hits(spark, rows, [(1, " ".join(item))])
    assert set(got) == {(1, 1), (2, 1), (4, 1)}
    assert got[(1, 1)]["coverage"] == 1.0 and got[(2, 1)]["coverage"] == 34 / 37 and not got[(1, 1)]["verbatim"] and got[(4, 1)]["verbatim"]


def test_inserted_words_between_consistent_slots(spark):
    """A question with new values alike everywhere and a name of two words passes; one with values mixed does not."""
    item = "If Tom has 5 apples and gives Mary 3 apples, then how many apples does Tom have after 5 days?"
    alike = "If Anna has 9 apples and kindly gives the good Paul 2 apples, then tell me how many apples does Anna have after 9 days?"
    mixed = "If Anna has 9 apples and kindly gives the good Paul 2 apples, then tell me how many apples does Zoe have after 4 days?"
    got = _hits(spark, [(1, alike), (2, mixed)], [(1, item)])
    assert set(got) == {(1, 1)} and got[(1, 1)]["coverage"] > 0.8 and got[(1, 1)]["consistency"] == 1.0


def test_long_verbatim_passage(spark):
    """28 words in a row of a 59-word item are less than half of it; 12 are too few; so are 28 with other values."""
    item = [f"{chr(97 + i % 26)}{'xyz'[i // 26]}word" if i % 5 else str(100 + i) for i in range(59)]
    other = [w if w.isalpha() else "7" + w for w in item]
    rows = [(1, " ".join(["a", "b", *item[10:38], "c"])), (2, " ".join(["a", *item[11:23], "c"])), (3, " ".join(["a", *other[10:38], "c"]))]
    got = _hits(spark, rows, [(1, " ".join(item))])
    assert set(got) == {(1, 1)} and got[(1, 1)]["coverage"] < 0.5
    # Of items that share a template, each item's values count.
    assert set(_hits(spark, rows, [(1, " ".join(item)), (2, " ".join(other))])) == {(1, 1), (3, 1)}


def test_items_of_few_literals(spark):
    """Exact copies of items that are mostly slots are found, each by its own values; other values are not."""
    sums = ["What is 513 + 278 + 91 + 44?", "What is 7 + 8 + 9 + 10?"]
    numbers = " ".join(str(i * i) for i in range(3, 23))
    names = "ask Anna, Bob, Carl, Dora, Emil, Fred, Gina, Hugo, Ida, Jan"
    items = [(1, sums[0]), (2, sums[1]), (3, numbers), (4, names), (5, "one more item that has more than enough literal words")]
    rows = [
        (1, f'They say: "{sums[0].replace("What", "what")}" and go'),
        (2, f"well, {sums[1]}"),
        (3, "What is 6 + 278 + 91 + 44?"),
        (4, f"a list {numbers} of squares"),
        (5, " ".join(str(i * i) for i in range(3, 11)) + " " + " ".join(str(i) for i in range(1000, 1040))),
        (6, f"now {names} and all"),
        (7, "now ask Karl, Lena, Mia, Nora, Otto, Paul, Rita, Sven, Tina, Uwe"),
    ]
    got = _hits(spark, rows, items)
    assert set(got) == {(1, 1), (2, 1), (4, 3), (6, 4)}  # items that share a template are one, under the smallest id
    assert all(r["coverage"] == 1.0 and r["consistency"] == 1.0 and r["verbatim"] for r in got.values())


def test_run_between_two_changed_words(spark):
    """20 words with those at places 4 and 13 changed: the run 5-12 of eight words aligns the document."""
    item = [f"{chr(97 + i)}word" for i in range(20)]
    changed = [w if i not in (4, 13) else "other" for i, w in enumerate(item)]
    got = _hits(spark, [(1, " ".join(["so", *changed, "end"]))], [(1, " ".join(item))])
    assert got[(1, 1)]["coverage"] == 0.9


def test_clean_null_and_repeated_ids(spark):
    """A contaminated row goes also under a null doc_id; a row that only shares its doc_id with one stays."""
    item = " ".join(f"{chr(97 + i)}word" for i in range(20))
    rows = [(None, item), (None, "clean one"), (1, item), (1, "another clean one"), (2, None), (3, item), (4, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = contamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(None, "clean one"), (1, "another clean one"), (2, None), (4, "clean")], key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.clean(docs, none).count() == len(rows)
