"""Links, components and removals against brute force, where buckets hold several components."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, linking, near_dup


class Union(dict):
    def top(self, x):
        while self.get(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.top(x), self.top(y)))
        if x != y:
            self[y] = x


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, m, n).astype(np.uint64)) for m, n in [(40, 30), (40, 10), (500, 60), (5, 5), (1, 1)] * 40]
    got = linking.intersections(sets)
    for i, x in enumerate(sets):
        for k, y in enumerate(sets):
            if i != k:
                assert got[i, k] == len(np.intersect1d(x, y))


def family(rng, n, length, edits):
    """Texts about one base below the threshold to each other, and for some of them a close copy of their own."""
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(length)]
    out = []
    for _ in range(n):
        some = list(base)
        for p in rng.sample(range(length), edits):
            some[p] = rng.choice(words)
        out.append(some)
        if rng.random() < 0.3:
            out.append([*some[:-1], rng.choice(words)])
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("percent", "block", "hubs"), [(85, 2048, True), (80, 2048, False), (85, 2048, False), (85, 16, False)])
def test_components_inside_crowded_buckets(spark, monkeypatch, percent, block, hubs):
    """Also with blocks so small that every bucket has many, and with no pairs from hubs, so that blocks find all links."""
    monkeypatch.setattr(near_dup, "border_links", partial(near_dup.border_links, block=block))
    if not hubs:
        without = lambda members: (members.withColumn("size", F.lit(3)).withColumn("hub", F.lit(-1)), members.selectExpr("id AS a", "id AS b").where("false"))
        monkeypatch.setattr(near_dup, "hub_pairs", without)
    texts = family(random.Random(percent + block), 150, 120, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    want = Union()
    for i, x in enumerate(sets):
        for k in range(i):
            if 100 * len(x & sets[k]) >= percent * len(x | sets[k]):
                want.join(i, k)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, percent=percent).collect()}
    assert got == {i: want.top(i) for i in range(len(texts))}
    assert 20 < len(set(got.values())) < len(texts) - 20


def test_one_document_of_several_texts(spark):
    """Rows that share a doc_id link through each of their texts, whichever class is that id's."""
    rng = random.Random(9)
    make = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(80)]
    a, b, c = make(), make(), make()
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (2, " ".join(b)), (3, near(b)), (5, " ".join(c)), (5, " ".join(b)), (6, near(c)), (7, "by itself")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7)}


def test_registers_merge():
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 500))
    of = lambda s: near_dup.SKETCH.values(near_dup.SKETCH.minima(s))
    assert (near_dup.merge(of(x), of(y)) == of(np.concatenate([x, y]))).all()


def removed(rows, percent=80):
    """Per document (by place) the numbers of the lines that go, by comparing all lines."""
    held = sorted({(i, t, n, x) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if x.strip()}, key=lambda v: (v[0], v[2]))
    distinct = sorted({x for *_, x in held})
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x).ljust(lines.SHINGLE, "\0") for x in distinct]
    sets = [{x[k : k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} for x in low]
    parts = Union()
    for i, x in enumerate(sets):
        for k in range(i):
            if 100 * len(x & sets[k]) >= percent * len(x | sets[k]):
                parts.join(i, k)
    at, seen, gone = {x: parts.top(i) for i, x in enumerate(distinct)}, set(), set()
    for i, t, n, x in held:
        if at[x] in seen:
            gone.add((i, t, n))
        seen.add(at[x])
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ban", "con", "dor", "fel", "gam") for b in ("ta", "ri", "mus", "le")]
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(12)]

    def line():
        x = rng.choice(base)
        if rng.random() < 0.7:
            for _ in range(rng.randrange(1, 5)):
                p = rng.randrange(len(x))
                x = x[:p] + rng.choice(["", "z", "Q", " "]) + x[p + 1 :]
        return x.upper() if rng.random() < 0.1 else x

    rows = [(i, "\n".join(line() if rng.random() < 0.9 else "  " for _ in range(rng.randrange(0, 9)))) for i in range(90)]
    rows += [(200, None), (None, base[0]), (201, ""), (202, "\n\n"), (203, "short"), (204, "short\nshort"), (205, "SHORT"), (206, base[1] * 3000 + "\n" + "é" * 9)]
    want = removed(rows)
    got = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    of = dict(rows)
    assert {(r["doc_id"], of[r["doc_id"]], n) for r in got.collect() for n in r["gone"]} == want and len(want) > 100


def test_lines_that_share_a_hash(spark, monkeypatch):
    """Two lines of one 64-bit hash, as forced here, are not taken for each other."""
    import xxhash

    honest = xxhash.xxh64_intdigest
    rows = [(1, "first of all these lines"), (2, "quite another one"), (3, "first of all these lines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.occurrences(docs.selectExpr("*", "xxhash64(text) AS own"), 4).where("line IS NOT NULL").collect()
    salt = honest((lines.CHECK).to_bytes(8, "little"), 42)
    for r, (_, text) in zip(sorted(found, key=lambda r: r["doc_id"]), rows, strict=True):
        assert np.uint64(honest(text.encode(), salt)).view(np.int64) == r["check"]
        assert spark.sql(f"SELECT xxhash64({lines.CHECK}L, '{text}')").first()[0] == r["check"]
    clashing = spark.createDataFrame([(9, r["check"], r["doc_id"], r["own"], r["line"], None, None, None) for r in found], "id long, check long, doc_id long, own long, line int, bucket long, part int, posts binary")
    monkeypatch.setattr(lines, "occurrences", lambda *a: clashing)
    monkeypatch.setattr(lines, "linked", lambda *a: clashing.selectExpr("id", "check", "id AS label").where("false"))
    assert [(r["doc_id"], r["gone"]) for r in lines.repeated_lines(docs).collect()] == [(3, [0])]


def test_clashing_names(spark):
    """Columns of the input that bear the names of those that are added."""
    rows = [(1, "a line that is here twice", 7, 8, 9), (2, "a line that is here twice\nand one more line", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, N_LINES int, __doc int")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_removed_"]
    assert {tuple(r) for r in out.collect()} == {(*rows[0], 1, 0), (2, "and one more line", 7, 8, 9, 2, 1)}
