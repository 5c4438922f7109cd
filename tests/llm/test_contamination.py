"""Re-parameterised questions: recall and precision on planted ones, and alignments against a plain implementation."""

import random

import pytest

from tessera.llm import contamination as c

regex = pytest.importorskip("regex")
NAMES = ["Anna", "Bob", "Carla", "Dieter", "Emma", "Farid", "Gina", "Hugo", "Iris", "Jonas"]
FILLER = [a + b for a in ("lo", "mi", "sa", "tu", "ver", "nor") for b in ("ra", "den", "kel", "pos", "til", "ma")]


def canonical(text):
    x = regex.sub("[-]", "", text)
    x = regex.sub(r"(?<!\S)[^\s\p{N}]*+\p{N}\S*", c.NUMBER, x)
    x = regex.sub(rf"(?<={c.NUMBER}\s)(?i:{c.UNITS})(?=[\s\p{{P}}]|$)", c.UNIT, x)
    x = regex.sub("\\p{Lu}(?<=[\\p{Ll},;\ue000\ue001] \\p{Lu})\\p{Ll}*+(?!\\p{L})", c.NAME, x)
    return regex.sub("[^\\p{L}\\p{M}\\s-]+", "", x.lower()).split()


def surface(text):
    return [w for w in text.split() if regex.search(r"[\p{L}\p{M}\p{N}]", w)]


def question(rng, n):
    """A template of n words: literals, and slots as (kind, index of the value)."""
    out = []
    for k in range(n):
        kind = rng.random()
        out.append((("name", rng.randrange(2)) if kind < 0.12 else ("number", rng.randrange(3)) if kind < 0.3 else f"q{rng.choice('abcdefghij')}{rng.choice('xyz')}{'uvw'[k % 3]}") if k > 1 else "say")
    return out


def filled(rng, template):
    """The template with one value for each slot, the same wherever the slot stands."""
    names, numbers = rng.sample(NAMES, 2), rng.sample(range(2, 900), 3)
    return [w if isinstance(w, str) else names[w[1]] if w[0] == "name" else str(numbers[w[1]]) for w in template]


def passes(text, item):
    """Whether some shift at which a window of at least LITERALS literal words agrees passes alone."""
    words, values, mine, own = canonical(text), surface(text), canonical(item), surface(item)
    n = len(mine)
    w = min(n, c.WINDOW)
    slot = (c.NUMBER, c.UNIT, c.NAME)
    shifts = {d - i for i in range(n - w + 1) if sum(x not in slot for x in mine[i : i + w]) >= min(c.LITERALS, n) for d in range(len(words) - w + 1) if words[d : d + w] == mine[i : i + w]}
    for s in shifts:
        at = [i for i in range(n) if 0 <= i + s < len(words) and words[i + s] == mine[i]]
        pairs = [(own[i], values[i + s]) for i in at if mine[i] in slot]
        agreed = sum(max(pairs.count(q) for q in set(pairs) if q[0] == x) for x in {p[0] for p in pairs})
        if len(at) / n >= c.COVERAGE and (not pairs or agreed / len(pairs) >= c.CONSISTENCY):
            return True
    return False


def test_planted_questions(spark):
    rng = random.Random(21)
    templates = [question(rng, n) for n in (10, 14, 18, 22, 26, 30, 37, 45, 59) for _ in range(4)]
    items = [(i, " ".join(filled(rng, t))) for i, t in enumerate(templates)]
    filler = lambda n: [rng.choice(FILLER) for _ in range(n)]
    rows, planted = [], {}
    for k in range(400):
        i = rng.randrange(len(templates))
        body = filled(rng, templates[i])
        if k % 4 == 1:  # one literal in ten changed
            body = [rng.choice(FILLER) if rng.random() < 0.1 else w for w in body]
        if k % 4 == 2:  # a word put in at two places
            for _ in range(2):
                body.insert(rng.randrange(1, len(body)), rng.choice(FILLER))
        if k % 4 == 3:
            body = []
        rows.append((k, " ".join([*filler(rng.randrange(1, 40)), *body, *filler(rng.randrange(1, 40))])))
        if body:
            planted[k] = (i, k % 4)
    got = {(r["doc_id"], r["item_id"]) for r in c.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not {(d, i) for d, i in got if planted.get(d, (None,))[0] != i}  # nothing but what was planted
    recall = {}
    for kind in (0, 1, 2):
        for size in ("short", "long"):  # of 22 words at least
            asked = [(d, i) for d, (i, k) in planted.items() if k == kind and (len(templates[i]) >= 22) == (size == "long")]
            recall[kind, size] = sum(x in got for x in asked) / len(asked)
    print(recall)
    assert recall[0, "short"] == recall[0, "long"] == 1.0 and recall[1, "long"] >= 0.9 and recall[2, "long"] >= 0.95 and recall[2, "short"] >= 0.6 and recall[1, "short"] >= 0.4
    texts = dict(rows)
    alone = {(d, i) for d, t in rows for i, item in items if passes(t, item)}
    assert alone <= got and len(alone) > 150
    # What more was found lies at several shifts.
    assert all(planted[d][1] in (1, 2) for d, _ in got - alone) and texts


def test_canonical_words(spark):
    rng = random.Random(4)
    parts = ["Anna", "anna,", "5", "km", "$12.50", "3-4", "feet", "He", "said;", "Bob", "ÉCOLE", "été", "x2y", "—", "miles.", "NASA", "", "O'Neil", "a.b", "7", "Mi", "ﬁne", "10%", "  ", "\n"]
    rows = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for t, r in zip(rows, df.select(c.canonical(df["text"]).alias("w"), c.surface(df["text"]).alias("v")).collect(), strict=True):
        assert [w for w in r["w"] if w] == canonical(t) and r["v"] == [w for w in surface(t.replace("", "")) if w], t
