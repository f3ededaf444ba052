"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins double the distance that each message knows upwards, which
gives every leaf its depth and score in logarithmically many joins; the leaves of a tree are ranked, and for those chosen
the same jumps list the messages from root to leaf. Each chosen path becomes one conversation in a template with a mark
before and after every turn. Control strings inside texts are escaped with a backslash, and can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecube.llm.common import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string (of this template and of others).
_REST = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|<?/SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    """One backslash more after the first character of everything that looks like a control string."""
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def _keyed(messages: DataFrame) -> DataFrame:
    """Trees as structs, which are equal if their nulls are, so that joins keep the tree that is null."""
    return messages.withColumn("tree", F.struct(F.col("tree").alias("key")))


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, depth, msg, position) for each message on the chosen paths of each tree.

    ``messages``: tree, msg (unique within the tree), parent (null or unknown: a root), score (null counts as 0). A
    path's score is the mean of its messages' scores; paths are ranked by score, then depth, both descending, then by
    leaf. Trees may have several roots. Messages on a cycle of parents have no root and are on no path. A null tree is a
    tree like any other. An empty table gives an empty result.
    """
    return _paths(_keyed(messages), best).withColumn("tree", F.col("tree.key"))


def _paths(messages: DataFrame, best: int) -> DataFrame:
    own = materialize(messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-messages")
    ids = own.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("known"))
    linked = own.join(ids, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    # up: the ancestor ``steps`` above; score: the sum over the messages passed, this one first.
    state = materialize(linked, "chat-jumps")
    jumps, done = [], state.where("up is null").select("tree", "msg", "score", "steps")
    count = own.count()
    reach = 1
    while True:
        active = state.where("up is not null").select("tree", "msg", "up", "score", "steps")
        if reach > count or active.isEmpty():
            break
        jumps.append(active.select("tree", "msg", "up"))
        above = state.select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        ended = done.select("tree", F.col("msg").alias("up"), F.col("score").alias("score3"), F.col("steps").alias("steps3"))
        met = active.join(above, ["tree", "up"], "left").join(ended, ["tree", "up"], "left")
        state = materialize(
            met.select("tree", "msg", F.when(F.col("steps3").isNull(), F.col("up2")).alias("up"), (F.col("score") + F.coalesce("score3", "score2")).alias("score"), (F.col("steps") + F.coalesce("steps3", "steps2")).alias("steps")), "chat-jumps"
        )
        done = materialize(done.union(state.where("up is null").select("tree", "msg", "score", "steps")), "chat-done")
        reach *= 2
    leaves = done.join(linked.where("up is not null").select("tree", F.col("up").alias("msg")).distinct(), ["tree", "msg"], "left_anti")
    ranked = leaves.withColumn("mean", F.col("score") / F.col("steps")).withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), F.desc("steps"), "msg"))).where(F.col("rank") <= best)
    chosen = materialize(ranked.select("tree", F.col("msg").alias("leaf"), "rank", F.col("mean").alias("score"), F.col("steps").alias("depth")), "chat-leaves")
    paths = chosen.select("tree", "leaf", F.col("leaf").alias("msg"), F.lit(0).cast("long").alias("below"))
    for k, jump in enumerate(jumps):
        higher = paths.join(jump, ["tree", "msg"]).select("tree", "leaf", F.col("up").alias("msg"), (F.col("below") + (1 << k)).alias("below"))
        paths = materialize(paths.union(higher), "chat-paths")
    return paths.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "depth", "msg", (F.col("depth") - F.col("below") - 1).alias("position"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each (tree, leaf) of (tree, leaf, position, role, text): formatted.

    Null texts and roles count as empty. A role is written percent-encoded, so that it cannot break its line.
    """
    turn = F.concat(F.lit(BEGIN), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    parts = turns.select("tree", "leaf", F.struct("position", turn.alias("t")).alias("p")).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return parts.select("tree", "leaf", F.array_join("ps.t", "").alias("formatted"))


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """``formatted`` with turns, an array of (role, text), as read from the output alone."""
    marks = F.split(column, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(marks, 1, F.size(marks) - 1), lambda b: F.substring(b, len(BEGIN) + 1, 2**31 - 1))

    def turn(b: Column) -> Column:
        at = F.position(F.lit("\n"), b)
        return F.struct(F.url_decode(F.substring(b, F.lit(1), at - 1)).alias("role"), unescape(F.substring(b, at + 1, F.lit(2**31 - 1))).alias("text"))

    return formatted.withColumn("turns", F.transform(bodies, turn))


def loss_texts(turns: Column) -> Column:
    """The texts that the loss reads: every assistant turn's, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, score, formatted for the chosen paths of (tree, msg, parent, role, text, score).

    Messages need to be unique by (tree, msg). Extra columns are not read.
    """
    messages = _keyed(messages)
    paths = _paths(messages, best)
    turns = paths.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
    heads = paths.where("position = 0").select("tree", "leaf", "rank", "score")
    return format_turns(turns).join(heads, ["tree", "leaf"]).select(F.col("tree.key").alias("tree"), "leaf", "rank", "score", "formatted")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each row replies to the one before it.

    Rows go by turn, null turns first; equal turns by role and text. Wholly equal rows are separate messages.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), n.alias("msg"), "role", "text").withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1)).withColumn("score", F.lit(0.0))
