"""Chat formatting of reply trees.

Each conversation is a tree of messages. Root-to-leaf paths are enumerated by self-joins that double the distance they
look up, so a thread of n turns takes log2(n) rounds; branches are ranked by score and each chosen path becomes one
formatted text with a loss mask over what the assistant says. DataFrame functions only.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Inside roles and texts ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``, so no control string can stand there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.storage import materialise

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees: each row answers the one before it, by turn, then role and text.

    Gives conv, node, parent, role, text and score (0). Null texts and roles are empty; rows with a null id are one
    conversation; a null turn comes first; repeated rows are turns of their own.
    """
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    numbered = rows.withColumn("node", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("conv", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """The nodes of the best root-to-leaf paths of each conversation: conv, leaf, branch (1: best), node, place (0: root).

    ``tree``: conv, node, parent (null: a root), score. A path's score is the sum of its nodes'; ties go to the smaller
    leaf. Paths that do not come from a root (a missing parent, a circle) are left out.
    """
    links = tree.select(F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("c"), "conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    links = materialise(links, "chat-links")
    longest = links.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    leaves = links.join(links.select("c", F.col("parent").alias("node")).distinct(), ["c", "node"], "left_anti")
    steps = leaves.select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jumps = links.filter("parent IS NOT NULL").select("c", "node", F.col("parent").alias("to"))
    jumps = jumps.join(links.select("c", F.col("node").alias("to")), ["c", "to"], "left_semi")
    distance = 1
    while distance < longest:
        higher = steps.join(jumps, ["c", "node"]).select("c", "leaf", F.col("to").alias("node"), (F.col("up") + distance).alias("up"))
        steps = materialise(steps.unionByName(higher), "chat-steps")
        distance *= 2
        if distance < longest:
            far = jumps.select("c", F.col("node").alias("to"), F.col("to").alias("far"))
            jumps = materialise(jumps.join(far, ["c", "to"]).select("c", "node", F.col("far").alias("to")), "chat-jumps")
    scored = steps.join(links, ["c", "node"])
    whole = scored.groupBy("c", "leaf").agg(
        F.sum("score").alias("score"), F.max(F.col("parent").isNull()).alias("rooted"), F.max("up").alias("depth")
    )
    order = Window.partitionBy("c").orderBy(F.desc("score"), "leaf")
    best = whole.filter("rooted").withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches)
    chosen = scored.join(best.select("c", "leaf", "depth", "branch"), ["c", "leaf"])
    return chosen.select("c", "conv", "leaf", "branch", "node", (F.col("depth") - F.col("up")).alias("place"))


def format_chats(tree: DataFrame, branches: int = 1, learn_from: str = "assistant") -> DataFrame:
    """One row for each chosen path: conv, branch, formatted and loss, the spans (start from 0, length; code points) of
    what the role ``learn_from`` says."""
    texts = tree.select(F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("c"), "node", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = paths(tree, branches).join(texts, ["c", "node"])
    head = F.concat(F.lit(START), "role", F.lit(SEPARATOR))
    piece = F.concat(head, "text", F.lit(END))
    before = Window.partitionBy("c", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length(head)
    turns = turns.withColumns({"piece": piece, "begin": begin})
    span = F.when(F.col("role") == escape(F.lit(learn_from)), F.struct(F.col("begin").cast("int").alias("start"), F.length("text").alias("length")))
    gathered = turns.groupBy("c", "conv", "leaf", "branch").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss")
    )
    return gathered.select("conv", "branch", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), as they were."""
    pieces = F.split(formatted, r"<\|im_end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        inner = F.split(F.substr(piece, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2)
        return F.struct(unescape(inner[0]).alias("role"), unescape(inner[1]).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    parts = F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
    return F.array_join(parts, "")
