"""Chat formatting of reply trees: iterative self-joins find all root-to-leaf paths, branches are ranked, each is formatted.

A message is (tree_id, node_id, parent_id, role, text, score). Paths grow by doubling: round k joins what is known of every
path with each message's 2^k-th ancestor and the ancestor table with itself, so a path of n messages takes log2(n) rounds,
and the joins are keyed by message, not by tree.

The template writes a turn as `### role: text</turn>` and a line feed. In roles and texts the characters that it is made of
are escaped (backslash as \\s, `#` as \\h, `<` as \\l, and in roles `:` as \\c), so no text can open or end a turn, and
parsing gives back every turn exactly. The loss mask lists (start, length) in characters of the assistant's escaped texts.

Defined results: null text and role are empty; a message whose parent does not exist is a root; messages that never reach
a root (cycles) are on no path; of branches with equal scores the one with the smaller leaf ranks first; an empty table
gives no conversations; very long texts are one turn each; other columns are ignored, whatever their names. (tree_id,
node_id) must be distinct and not null; `from_turns` makes them so of rows that repeat and of null conversations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace, slices

OPEN, END = "### ", "</turn>\n"
_CODES = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def escape(s: str, role: bool = False) -> str:
    for plain, code in _CODES if role else _CODES[:3]:
        s = s.replace(plain, code)
    return s


def unescape(s: str) -> str:
    for plain, code in reversed(_CODES):
        s = s.replace(code, plain)
    return s


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '', True)}: ", escape(text or "")
        if role == learn:
            mask.append((at + len(head), len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def parse(conversation: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for turn in conversation.split(END)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(": ")
        out.append((unescape(role), unescape(text)))
    return out


def masked(conversation: str, mask: list[tuple[int, int]]) -> str:
    """The text under a mask, unescaped."""
    return "".join(unescape(conversation[start : start + n]) for start, n in mask)


def paths(messages: DataFrame, ws: Workspace) -> DataFrame:
    """(tree_id, leaf, node_id, depth) for each message of each root-to-leaf path; depth 0 is the leaf."""
    links = ws.table(messages.select("tree_id", "node_id", "parent_id"), "links")
    known = links.select("tree_id", F.col("node_id").alias("parent_id"))
    up = links.join(known, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("parent_id").alias("up"))
    up = ws.table(up, "up")
    leaves = links.join(up.select("tree_id", F.col("up").alias("node_id")), ["tree_id", "node_id"], "left_anti")
    roots = links.join(up.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id")
    most = links.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    found = ws.table(leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("depth")), "paths")
    step = 1
    while step < most and not up.isEmpty():
        more = found.join(up, ["tree_id", "node_id"]).select("tree_id", "leaf", F.col("up").alias("node_id"), (F.col("depth") + step).alias("depth"))
        found = ws.table(found.unionByName(more), "paths")
        far = up.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        up = ws.table(up.join(far, ["tree_id", "up"]).select("tree_id", "node_id", F.col("next").alias("up")), "up")
        step *= 2
    whole = found.join(roots, ["tree_id", "node_id"], "left_semi").select("tree_id", "leaf")
    return found.join(whole, ["tree_id", "leaf"], "left_semi")


def format_trees(messages: DataFrame, ws: Workspace, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree_id, leaf, rank, score, n_turns, conversation, mask. best: paths a tree, None for all.

    A path's score is the mean of its messages' scores, nulls left out.
    """
    found = ws.table(paths(messages, ws), "found")
    rows = found.join(messages.select("tree_id", "node_id", "role", "text", "score"), ["tree_id", "node_id"])
    turns = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "role", "text"))).alias("turns")
    branch = rows.groupBy("tree_id", "leaf").agg(turns, F.avg("score").alias("score"))
    order = Window.partitionBy("tree_id").orderBy(F.desc_nulls_last("score"), "leaf")
    branch = branch.withColumn("rank", F.row_number().over(order))
    if best is not None:
        branch = branch.where(F.col("rank") <= best)
    tree = branch.schema["tree_id"].dataType.simpleString(), branch.schema["leaf"].dataType.simpleString()
    mask = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def formatted(batches):
        for b in slices(batches, 64):
            out = [render([(t["role"] or "", t["text"] or "") for t in turns], learn) for turns in b.column(4).to_pylist()]
            texts = pa.array([t for t, _ in out], pa.string())
            masks = pa.array([[{"start": s, "length": n} for s, n in m] for _, m in out], mask)
            sizes = pa.array([len(t) for t in b.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], sizes, texts, masks], ["tree_id", "leaf", "rank", "score", "n_turns", "conversation", "mask"])

    schema = f"tree_id {tree[0]}, leaf {tree[1]}, rank int, score double, n_turns long, conversation string, mask array<struct<start:bigint,length:bigint>>"
    return branch.select("tree_id", "leaf", "rank", "score", "turns").mapInArrow(formatted, schema)


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text): each turn replies to the one before it. Repeated turns follow each other."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    n = F.row_number().over(order).cast("long")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree_id"), n.alias("node_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))
