"""Reply trees of other shapes than those of the query."""

from tessera.llm import chat

KIND = "conv_id long, node long, parent long, score double, role string, text string, root string"


def test_deep_and_wide_trees(spark):
    """A chain of 300 messages, a root with 200 replies, and a text of a million characters."""
    rows = [(1, i, i - 1 if i else None, 1.0, "user" if i % 2 == 0 else "assistant", f"m{i}", "x") for i in range(300)]
    rows += [(2, 0, None, 0.0, "user", "q", "x")] + [(2, i, 0, float(i % 7), "assistant", "<|end|>\n" * (i % 3), "x") for i in range(1, 201)]
    rows += [(3, 0, None, 0.0, "user", "\\<[" * 333_333, "x")]
    got = {}
    for r in chat.conversations(spark.createDataFrame(rows, KIND).repartition(6), 3).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 3, 3: 1}
    assert chat.read_turns(got[1][0]["formatted"]) == [(r[4], r[5]) for r in rows[:300]] and got[1][0]["path_score"] == 300.0
    assert sorted(r["leaf"] for r in got[2]) == [6, 13, 20]  # of equal scores the smallest leaves
    assert chat.read_turns(got[3][0]["formatted"]) == [("user", "\\<[" * 333_333)]


def test_null_conversation(spark):
    """A null conv_id is one conversation, beside those of its messages' numbers."""
    turns = spark.createDataFrame([(None, 1, "assistant", "b"), (None, 0, "user", None), (0, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: chat.read_turns(r["formatted"]) for r in chat.conversations(chat.chains(turns)).collect()}
    assert got == {None: [("user", ""), ("assistant", "b")], 0: [("user", "c")]}
