"""Rules, keywords and suppression against a plain implementation."""

import random
import re

import pytest

from tessera.llm import licenses

regex = pytest.importorskip("regex")
COMPILED = [(r["label"], r["priority"], regex.compile(r["pattern"])) for r in licenses.rules()]
SAMPLES = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-or-later", "the MIT License", "MIT license; mit-license", "Copyright (c) 2019 somebody. All rights reserved.",
    "GNU Lesser General Public License", "GNU General Public License", "https://opensource.org/licenses/BSD-3-Clause", "licensed under the terms of a Foo Bar license",
    "Redistribution and use in source and binary forms, with or without modification", "without warranty of any kind", "Creative Commons Attribution-ShareAlike 4.0 International License",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License", "see the license file", "http://www.mozilla.org/MPL/2.0/", "released into the public domain",
    "submit licenses", "the WTFPL", "under the terms of the GNU General Public License", "licensed under the Eclipse Public License", "limited license", "general public", "İstanbul licence é", "K license",
]


def survivors(text):
    """Labels by comparing all pairs of detections."""
    low = text.lower()
    found = [(m.start(), -m.end(), p, i, label) for i, (label, p, pattern) in enumerate(COMPILED) for m in pattern.finditer(low)]
    found.sort()
    kept = set()
    for k, (a, b, p, _, label) in enumerate(found):
        above = any(y[2] < p and y[0] < -b and -y[1] > a for y in found)
        inside = any(y[2] <= p and -y[1] >= -b for y in found[:k])
        if not above and not inside:
            kept.add((label, p))
    return kept


def spots(text, phrase):
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase], len(words)


def test_many_hand_written_rules():
    written = [p for some in (licenses.NAMES, licenses.TEXTS, licenses.MENTIONS) for v in some.values() for p in v]
    assert len(written) == len(set(written)) > 250
    for r in licenses.rules():
        assert any(s in x for x in licenses.literals(r["pattern"]) for s in licenses.STEMS), r


def test_keywords_stand_in_all_matches():
    low = [s.lower() for s in SAMPLES]
    for r, (_, _, pattern) in zip(licenses.rules(), COMPILED, strict=True):
        for s in low:
            for m in pattern.finditer(s):
                assert r["keyword"] in m[0]
    with pytest.raises(ValueError):
        licenses.literals("a|b")
    assert licenses.literals(r"ab?c\.d[xy]e(?:f|g)h+i*\bj") == ["a", "c.d", "e", "h", "j"]


def test_against_plain_implementation(spark):
    rng = random.Random(2)
    rows = [(i, s) for i, s in enumerate(SAMPLES)]
    rows += [(100 + i, rng.choice([" ", ", ", "\n", ""]).join(rng.choice(SAMPLES) for _ in range(rng.randrange(2, 9)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "x" * 200_000 + " mit license"), (900, None)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, labels string, kept int").repartition(4)
    got = sorted(((r["doc_id"], r) for r in licenses.scan(docs).collect()), key=lambda x: x[0])
    assert len(got) == len(rows)
    for (i, text), (j, r) in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        assert i == j
        kept = survivors(text or "")
        at = {label: spots(text or "", phrase)[0] for label, phrase in licenses.BASE.items()}
        every = [k for v in at.values() for k in v]
        base = sorted(label for label, v in at.items() if v)
        weight = max([licenses.WEIGHTS[p] for _, p in kept] + [licenses.WEIGHTS[2]] * bool(base) + [0.0])
        want = (len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted({*base, *(label for label, _ in kept)})), weight)
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == want, text
    assert licenses.scan(docs.where("false")).count() == 0


def test_lower_priority_gives_way(spark):
    rows = [(1, "licensed under the Apache License"), (2, "licensed under the terms of the Foo license"), (3, "under the terms of the GNU General Public License")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache", 2: "generic-license", 3: "gpl"}


def test_many_hits(spark):
    """Time grows with the number of hits, not with its square."""
    import time

    took = {}
    for n in (200, 4_000, 32_000):
        df = spark.createDataFrame([(1, "the MIT License, " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert licenses.scan(df).first()["n_base"] == n
        took[n] = time.perf_counter() - began
    assert took[32_000] < 16 * took[4_000] + 2
    print(took)
