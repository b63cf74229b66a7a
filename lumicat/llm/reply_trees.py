"""Chat formatting of reply trees: every root-to-leaf path is a branch, the best branches become conversations.

Messages name their parent. Iterative self-joins by path doubling find all ancestors in as many rounds as
the depth has binary digits: round k knows each message's ancestor 2^k steps up, its number of ancestors
and the sum of their scores. Branches are ranked within their conversation by that sum, then by length, then by
the id of the leaf. The paths of chosen leaves double in the same way, each row of a path being made once.

Each path is formatted as turns ``<turn role>text</turn>`` with a newline behind each. In a text, ``<turn`` and
``</turn`` get a backslash behind ``<`` (one more where some stand there), so a formatted text never holds a control
string and ``read_turns`` gives back what went in. The loss mask is the list of code point spans of the texts of the
trained role.

Defined cases: a null text or role is empty; a null score is 0. A null conversation id is a conversation of its own.
A parent that is no message of the conversation makes a root; so does no parent. Messages on or below a cycle of
parents are reached from no root and are in no path. Rows that repeat an id of a conversation count once, with the smallest
(parent, role, text). Rows with a null ``node_id`` are left out. Extra columns are ignored. An empty table gives an empty result.
One path is one row and must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.session import checkpointed

#: fixed values: what begins and ends a turn
BEGIN, END = "<turn ", "</turn>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def _same(left: DataFrame, right: DataFrame, column: str, to: str) -> Column:
    """Rows of ``left`` beside those of ``right`` (_c, _to) of the same conversation."""
    return left["conv_id"].eqNullSafe(right["_c"]) & (left[column] == right[to])


def _messages(messages: DataFrame) -> DataFrame:
    """conv_id, node_id, parent_id, role, text, score, one row per message."""
    own = messages.where(F.col("node_id").isNotNull()).select("conv_id", "node_id", F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")).alias("m"))
    return own.groupBy("conv_id", "node_id").agg(F.min("m").alias("m")).select("conv_id", "node_id", "m.*")


def ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """State (conv_id, node_id, n_turns, score) of messages below a root, and per round k the ancestors 2^k steps up.

    ``messages`` has conv_id, node_id, parent_id and score, one row per message.
    """
    known = messages.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"))
    linked = messages.join(known, _same(messages, known, "parent_id", "_n"), "left")
    state = checkpointed(linked.select("conv_id", "node_id", F.col("_n").alias("up"), F.lit(1).cast("long").alias("n_turns"), "score"))
    total, jumps = state.count(), []
    while not (active := state.where("up is not null")).isEmpty():
        if 1 << len(jumps) > total:  # longer than any path: below a cycle
            break
        jumps.append(active.select("conv_id", "node_id", "up"))
        above = state.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("n_turns").alias("_t"), F.col("score").alias("_s"))
        joined = active.join(above, _same(active, above, "up", "_n"))
        moved = joined.select("conv_id", "node_id", F.col("_up").alias("up"), (F.col("n_turns") + F.col("_t")).alias("n_turns"), (F.col("score") + F.col("_s")).alias("score"))
        state = checkpointed(state.where("up is null").unionByName(moved))
    return state.where("up is null").drop("up"), jumps


def branches(state: DataFrame, jumps: list[DataFrame], keep: int | None = 1) -> DataFrame:
    """conv_id, leaf_id, n_turns, score, rank of the best ``keep`` branches of each conversation, or of all."""
    leaves = state
    if jumps:
        parents = jumps[0].select(F.col("conv_id").alias("_c"), F.col("up").alias("_n")).distinct()
        leaves = state.join(parents, _same(state, parents, "node_id", "_n"), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("n_turns"), "leaf_id")
    ranked = leaves.withColumnRenamed("node_id", "leaf_id").withColumn("rank", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """conv_id, leaf_id, node_id, steps above the leaf: each message of each chosen branch."""
    rows = checkpointed(chosen.select("conv_id", "leaf_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("steps")))
    for k, jump in enumerate(jumps):
        up = jump.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "up")
        further = rows.join(up, _same(rows, up, "node_id", "_n")).select("conv_id", "leaf_id", F.col("up").alias("node_id"), (F.col("steps") + (1 << k)).alias("steps"))
        rows = checkpointed(rows.unionByName(further))
    return rows


def format_turns(turns: DataFrame, key: list[str], trained: str = TRAINED) -> DataFrame:
    """key, formatted, loss_mask (start, length in code points) of turns (key, pos, role, text)."""
    head = F.concat(F.lit(BEGIN), _role_out(F.col("role")), F.lit(">"))
    made = turns.select(*key, "pos", head.alias("_head"), escaped(F.col("text")).alias("_text"), (F.col("role") == trained).alias("_trained"))
    made = made.withColumn("_piece", F.concat("_head", "_text", F.lit(END)))
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_piece").cast("long")).over(before), F.lit(0)) + F.length("_head")
    placed = made.select(*key, F.struct("pos", F.col("_piece").alias("piece"), F.when(F.col("_trained"), F.struct(start.alias("start"), F.length("_text").cast("long").alias("length"))).alias("span")).alias("t"))
    held = placed.groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select(*key, F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"))


def format_trees(messages: DataFrame, keep: int | None = 1, trained: str = TRAINED) -> DataFrame:
    """conv_id, leaf_id, rank, n_turns, score, formatted, loss_mask: one row per chosen branch.

    ``messages`` has conv_id, node_id, parent_id, role, text and score.
    """
    own = checkpointed(_messages(messages))
    state, jumps = ancestors(own.select("conv_id", "node_id", "parent_id", "score"))
    chosen = checkpointed(branches(state, jumps, keep))
    held = own.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "role", "text")
    placed = paths(chosen, jumps)
    turns = placed.join(held, _same(placed, held, "node_id", "_n")).select("conv_id", "leaf_id", (-F.col("steps")).alias("pos"), "role", "text")
    formatted = format_turns(turns, ["conv_id", "leaf_id"], trained).withColumnsRenamed({"conv_id": "_c", "leaf_id": "_n"})
    return chosen.join(formatted, _same(chosen, formatted, "leaf_id", "_n")).select("conv_id", "leaf_id", "rank", "n_turns", "score", "formatted", "loss_mask")


def chains(turns: DataFrame) -> DataFrame:
    """Conversations without branches as trees: each turn (conv_id, turn, role, text) answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return numbered.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, END)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(_role_in(F.substring_index(p, ">", 1).substr(F.lit(len(BEGIN) + 1), F.length(p))).alias("role"), unescaped(p.substr(F.instr(p, ">") + 1, F.length(p))).alias("text")),
    )


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, joined by nothing."""
    return F.array_join(F.transform(loss_mask, lambda m: unescaped(formatted.substr((m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
