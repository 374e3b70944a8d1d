"""Chat formatting of reply trees.

Messages name the message they answer. Paths from roots to leaves are followed by
iterative self-joins that double the known stretch above each message, so a
path of n messages takes log2(n) joins. Of a tree's paths, the one of the best
total score is chosen (ties: the longer, then the least leaf), and formatted as
one conversation with a loss mask over the assistants' texts.

The template opens a turn with a start mark, the role and a line feed, and closes
it with an end mark and a line feed. Inside roles and texts a backslash is doubled
and the `<|` that begins every mark becomes `<\\|`; undoing these in reverse gives
the texts back. Places are counted in code points. Only DataFrame functions are used.

Defined cases: a null text or role is empty; conversations and texts may be of any length; a message whose parent is missing is
a root; turns that tie in order are taken by role and text; repeated rows are
turns of their own; messages on a cycle have no root and are left out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def linear(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages tree, node, parent, role, text, score of conversations whose rows follow one another by turn."""
    in_order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    rows = rows.withColumn("node", F.row_number().over(in_order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tree(c: str = "tree") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias("tree")


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """State tree, node, depth, score of every message that a root reaches, and jump tables.

    The r-th jump table leads from a message to the one 2**r above it. A message's row
    holds numbers alone, whatever its depth, and only messages that have not reached
    their root are joined again. More steps than there are messages mean a cycle.
    """
    rows = messages.select(_tree(), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["tree", "parent"], "left")
    state = cut(rows.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), "score", F.lit(1).cast("long").alias("depth")))
    most, jumps = state.count(), []
    while True:
        open_ = state.where("above IS NOT NULL")
        if open_.isEmpty():
            return state.drop("above"), jumps
        jumps.append(open_.select("tree", "node", "above"))
        over = state.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"), F.col("depth").alias("rest"))
        higher = open_.join(over, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("rest")).alias("depth"))
        state = cut(state.where("above IS NULL").unionByName(higher.where(F.col("depth") <= most)))


def leaf_scores(messages: DataFrame, state: DataFrame) -> DataFrame:
    """tree, leaf, depth, score of every path from a root to a leaf."""
    inner = messages.select(_tree(), F.col("parent").alias("node")).distinct()
    return state.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "depth", "score")


def best_leaves(found: DataFrame) -> DataFrame:
    """The chosen path of each tree, by its leaf."""
    return found.groupBy("tree").agg(F.max_by("leaf", F.struct("score", "depth", (-F.col("leaf")).alias("leaf"))).alias("leaf"))


def walk(chosen: DataFrame, state: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """tree, leaf, at, node: all messages on the chosen paths; the longest jumps first, each doubles what is known."""
    seen = chosen.select("tree", "leaf", F.col("leaf").alias("node"))
    for jump in reversed(jumps):
        seen = cut(seen)
        seen = seen.unionByName(seen.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node")))
    return seen.join(state.select("tree", "node", F.col("depth").alias("at")), ["tree", "node"])


def formatted(messages: DataFrame, steps: DataFrame, start: str = START, end: str = END, speaks: str = ASSISTANT) -> DataFrame:
    """tree, leaf, output, loss (array of start, length) of steps(tree, leaf, at, node)."""
    texts = messages.select(_tree(), "node", "role", "text")
    rows = steps.join(texts, ["tree", "node"])
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(start), role, F.lit("\n"))
    turn = F.concat(head, text, F.lit(end), F.lit("\n"))
    turns = rows.select("tree", "leaf", "at", turn.alias("turn"), F.length(head).alias("n_head"), F.length(text).cast("long").alias("length"), F.coalesce(F.col("role") == speaks, F.lit(False)).alias("mask"))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", (F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("n_head")).cast("long"))
    grouped = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"), F.array_sort(F.collect_list(F.when(F.col("mask"), F.struct("start", "length")))).alias("loss"))
    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("output"), "loss")


def read_back(outputs: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """tree, leaf, turns (role, text), masked (texts under the loss mask), formatted_chars, parsed from the output alone.

    A turn's place is the running sum of the lengths before it, and each stretch of the
    mask meets the turn that begins last before it, so the work grows with the length.
    """
    # Escaped texts hold no mark, so the marks part the turns.
    parts = outputs.select("tree", "leaf", F.posexplode(F.split("output", _literal(start))).alias("n", "part")).where("n > 0")
    role = unescape(F.substring_index("part", "\n", 1))
    text = F.expr(f"substring(part, instr(part, '\n') + 1, length(part) - instr(part, '\n') - {len(end) + 1})")
    in_order = Window.partitionBy("tree", "leaf").orderBy("n")
    place = F.sum(F.length("part") + F.lit(len(start))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("part")
    turns = parts.select("tree", "leaf", "n", "part", place.cast("long").alias("place"), role.alias("role"), unescape(text).alias("text"))
    masks = outputs.select("tree", "leaf", F.explode("loss").alias("m"))
    both = turns.select("tree", "leaf", "place", "n", "part", "role", "text", F.lit(None).cast("long").alias("length")).unionByName(
        masks.select("tree", "leaf", F.col("m.start").alias("place"), F.col("m.length").alias("length")), allowMissingColumns=True
    )
    so_far = Window.partitionBy("tree", "leaf").orderBy("place", F.col("length").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = F.last(F.when(F.col("n").isNotNull(), F.struct("place", "part")), True).over(so_far)
    met = both.withColumn("of", of)
    masked = F.when(F.col("n").isNull(), F.struct("place", unescape(F.expr("substring(of.part, int(place - of.place) + 1, int(length))")).alias("text")))
    read = met.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "role", "text")))).alias("turns"),
        F.array_sort(F.collect_list(masked)).alias("masked"),
        F.sum(F.when(F.col("n").isNotNull(), F.length("part") + F.lit(len(start)))).cast("long").alias("formatted_chars"),
    )
    return read.select("tree", "leaf", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.transform("masked", lambda x: x["text"]).alias("masked"), "formatted_chars")


def _literal(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in mark)


def digests(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of linear conversations."""
    messages = cut(linear(turns, **columns))
    state, jumps = climb(messages)
    back = read_back(cut(formatted(messages, walk(best_leaves(leaf_scores(messages, state)), state, jumps))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("masked", "")
    return back.select(
        F.col("tree").try_cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
