"""Levels of repeated passages against brute force, and the query against its SQL."""

import collections
import random

import pytest

from tessera.llm import substrings


def longest(words, length):
    """Per text the greatest of length, 2 * length, ... at which one of its windows starts anywhere else too, or 0."""
    out, now = [0] * len(words), length
    while True:
        seen = collections.Counter(tuple(w[k : k + now]) for w in words for k in range(len(w) - now + 1))
        hit = [any(seen[tuple(w[k : k + now])] > 1 for k in range(len(w) - now + 1)) for w in words]
        if not any(hit):
            return out
        out, now = [now if h else x for h, x in zip(hit, out, strict=True)], 2 * now


def made(rng):
    """Texts with passages of 3 to 300 words out of a common stock, some of them over and over inside one text."""
    words = [f"w{i}" for i in range(40)]
    stock = [[rng.choice(words) for _ in range(n)] for n in (3, 6, 7, 11, 12, 13, 23, 24, 25, 47, 48, 49, 96, 97, 300)]
    out = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            some = rng.choice(stock)
            a = rng.randrange(len(some))
            text += [rng.choice(words) for _ in range(rng.randrange(12))] + (some if rng.random() < 0.6 else some[a:])
        out.append(text)
    return [*out, out[0], stock[5] * 9, ["x"] * 130, ["x"] * 11, ["y"] * 12, ["z"] * 13]


@pytest.mark.parametrize("together", [substrings.TOGETHER, 0, 4000])
def test_levels(spark, together):
    for seed, length in ((1, 12), (2, 12), (3, 7)):
        words = made(random.Random(seed))
        rows = [(None if i % 10 == 3 else i % 50, " ".join(w)) for i, w in enumerate(words)]
        got = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, together=together)
        seen = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
        want = collections.Counter()
        for (i, _), w, most in zip(rows, words, longest(words, length), strict=True):
            gone = {j for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for j in range(k, k + length)}
            want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), most)] += 1
        assert collections.Counter(map(tuple, got.collect())) == want


def test_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", "x", 2, 3), (2, None, "x", 2, 3), (2, "", "x", 2, 3)], "doc_id long, text string, spots string, own int, runs int")
    assert sorted(map(tuple, substrings.remove(docs, 3).collect())) == [(1, 6, 6, "", 3), (2, 0, 0, "", 0), (2, 0, 0, "", 0)]
    assert substrings.remove(docs.where("false"), 3).count() == 0


def test_rows_alike_list_their_windows_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text)] * 200 + [(7, text)] * 50, "doc_id long, text string").repartition(8)
    found = substrings.repeated(substrings.keyed(docs), 12).collect()
    assert sorted((r["doc_id"] or 0, sum(s["n"] for s in r["spots"])) for r in found) == [(0, 29), (7, 29)]
    got = collections.Counter(map(tuple, substrings.remove(docs, 12).collect()))
    assert got == {(None, 40, 40, "", 24): 200, (7, 40, 40, "", 24): 50}
