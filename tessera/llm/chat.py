"""Conversations from reply trees.

Messages name their parents. Self-joins that double in reach (parent, grandparent, ...) give every message its root,
depth and the sum of scores on its way, so a tree of depth d takes log2(d) of them; leaves are ranked by that sum under
each root, and the chosen paths are unrolled by the same tables backwards. Each becomes one conversation:

    <|turn|>role<|text|>text<|end|>newline

In roles and texts every backslash, < and [ is preceded by a backslash, so neither these marks nor others such as </s>
or [INST] can occur inside, and removing that backslash restores the text. loss holds the code-point spans of assistants'
texts in the formatted string.

Defined results: null role or text counts as empty; a parent that does not exist makes its child a root; messages on a
cycle have no root and belong to no path; of rows with equal (conv_id, node) one stays, the least by (parent, score, role,
text); of paths of equal score the smaller leaf comes first; a null conv_id is a conversation of its own; a null node is
left out; trees of any depth and texts of any length are taken whole, one conversation being one row; other columns are
ignored, whatever their names; no rows give no conversations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import columns, forget, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_KEY = ["conv_id", "node"]


def escape(text: str | None) -> str:
    return re.sub(r"([\\<\[])", r"\\\1", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation of (role, text) turns, and the spans of assistants' texts in it."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of format_turns()'s string."""
    marks = f"{re.escape(TURN)}((?:\\\\.|[^\\\\<])*){re.escape(TEXT)}((?:\\\\.|[^\\\\<])*){re.escape(END)}"
    return [(unescape(r), unescape(t)) for r, t in re.findall(marks, formatted, flags=re.DOTALL)]


def chains(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages, each replying to the one before it by turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = columns(turns, "conv_id", "turn", "role", "text").withColumn("node", node)
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, path_score, node, distance): the messages of the best `branches` root-to-leaf paths of every root.

    tree: (conv_id, node, parent, score). distance counts from the leaf, which has 0.
    """
    return _unwrapped(_paths(_wrapped(columns(tree, "conv_id", "node", "parent", "score")), branches))


def _wrapped(df: DataFrame) -> DataFrame:
    """conv_id as a struct, which joins take as equal where it holds null on both sides."""
    return df.withColumn("conv_id", F.struct(F.col("conv_id").alias("id")))


def _unwrapped(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.col("conv_id.id"))


def _paths(tree: DataFrame, branches: int) -> DataFrame:
    known = columns(tree, *_KEY).withColumnRenamed("node", "parent").withColumn("found", F.lit(True))
    start = tree.join(known, ["conv_id", "parent"], "left")
    up = F.when(F.col("found"), F.col("parent"))
    jumps = [table(start.select(*_KEY, up.alias("up"), F.lit(1).cast("long").alias("far"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.when(up.isNull(), F.col("node")).alias("root")), "jump")]
    limit = 1
    while jumps[-1].where("up IS NOT NULL").limit(1).count():
        if len(jumps) > limit:  # a cycle, if the reach exceeds the number of messages
            if 2 ** len(jumps) > 2 * jumps[0].count():
                break
            limit = len(jumps) + 4
        one, two = jumps[-1].where("up IS NOT NULL").alias("x"), jumps[-1].alias("y")  # the others have arrived
        joined = one.join(two, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.up") == F.col("y.node")), "left")
        further = joined.select("x.conv_id", "x.node", F.col("y.up").alias("up"), (F.col("x.far") * 2).alias("far"), (F.col("x.sum") + F.coalesce("y.sum", F.lit(0.0))).alias("sum"), F.coalesce("x.root", "y.root").alias("root"))
        jumps.append(table(further.unionByName(jumps[-1].where("up IS NULL")), "jump"))
    inner = jumps[0].where("up IS NOT NULL").select("conv_id", F.col("up").alias("node")).distinct()
    leaves = jumps[-1].where("root IS NOT NULL").join(inner, _KEY, "left_anti")
    best = F.row_number().over(Window.partitionBy("conv_id", "root").orderBy(F.desc("sum"), "node"))
    chosen = leaves.withColumn("rank", best).where(F.col("rank") <= branches)
    out = table(chosen.select("conv_id", F.col("node").alias("leaf"), F.col("sum").alias("path_score"), "node", F.lit(0).cast("long").alias("distance")), "path")
    for jump in reversed(jumps[:-1]):
        step = jump.where("up IS NOT NULL").select(*_KEY, "up", "far")
        more = out.join(step, _KEY).select("conv_id", "leaf", "path_score", F.col("up").alias("node"), (F.col("distance") + F.col("far")).alias("distance"))
        last, out = out, table(out.unionByName(more), "path")
        forget(last)
    for jump in jumps:
        forget(jump)
    return out


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, path_score, formatted, loss) of the chosen paths of messages (conv_id, node, parent, score, role, text)."""
    messages = columns(messages, "conv_id", "node", "parent", "score", "role", "text").where("node IS NOT NULL")
    one = messages.groupBy(*_KEY).agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select(*_KEY, "m.*")
    one = table(_wrapped(one), "messages")
    rows = _paths(one.select("conv_id", "node", "parent", "score"), branches).join(one.select(*_KEY, "role", "text"), _KEY)
    turns = _unwrapped(rows.groupBy("conv_id", "leaf", "path_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("order"), "role", "text"))).alias("turns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, loss = [], []
            for turns in batch.column(3):
                text, spans = format_turns([(t["role"].as_py(), t["text"].as_py()) for t in turns.values])
                texts.append(text)
                loss.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(loss, kind)], ["conv_id", "leaf", "path_score", "formatted", "loss"])

    return turns.mapInArrow(run, "conv_id long, leaf long, path_score double, formatted string, loss array<struct<start:long,end:long>>")
