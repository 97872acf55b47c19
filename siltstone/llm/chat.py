"""Reply trees to conversations. DataFrame functions only.

Messages name their parent; a conversation without parents is the chain of its
turns. Self-joins with doubling steps (1, 2, 4 ... replies up) give every
message its root, depth and score along the path from the root, in as many
joins as the deepest path has binary digits. Leaves are branches: they are
ranked by path score, and the chosen ones collect their paths by the same
pointers, largest step first. Each path becomes one formatted conversation.

Template of one turn: ``### role`` / text / ``</turn>``, each ended by a line
feed. Inside roles and texts ``\\``, ``<`` and ``#`` become ``\\\\``, ``\\l`` and
``\\h`` (and in roles a line feed ``\\n``), so no control string can occur there,
and decoding is exact. The loss mask lists the code points of assistant texts.

Edge cases: null texts and roles are empty; turns that share a number are
ordered by role, then text, so equal rows stay as repeated turns; a parent that
does not exist makes a root; a reply cycle has no root and is not a branch;
null conversation ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import staged

_TURN_END = "</turn>\n"


def chain(turns: DataFrame) -> DataFrame:
    """``conv_id, node, parent, role, text, score`` from rows by turn: each turn replies to the one before."""
    clean = turns.select("conv_id", "turn", F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = clean.select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``conv, node, up``: the ancestor 1, 2, 4 ... replies up; and ``conv, node, depth, total`` of rooted nodes."""
    same = ["conv", "node"]
    parents = nodes.select("conv", F.col("node").alias("up")).withColumn("there", F.lit(True))
    linked = nodes.select("conv", "node", F.col("parent").alias("up"), "score").join(parents, ["conv", "up"], "left")
    step = linked.select(*same, F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).alias("depth"), F.col("score").alias("total"))
    limit = (nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1).bit_length()
    tables: list[DataFrame] = []
    for _ in range(limit + 1):
        step = staged(step, "reply-pointers")
        going = step.where("up IS NOT NULL").select(*same, "up")
        if not going.take(1):
            return tables, step.select(*same, "depth", "total")
        tables.append(going)
        above = step.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        # Only messages that still point somewhere go on; the rest are known.
        ahead = step.where("up IS NOT NULL").join(above, ["conv", "up"])
        ahead = ahead.select(*same, F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        step = step.where("up IS NULL").unionByName(ahead)
    return tables, step.where("up IS NULL").select(*same, "depth", "total")  # what still points somewhere lies on a cycle


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``conv_id, branch, depth, role, text``: the messages on the ``branches`` best paths of each tree.

    ``messages`` has ``conv_id, node, parent, role, text, score`` with unique (conv_id, node); ``branches=None`` keeps all.
    """
    conv = F.struct(messages["conv_id"])
    nodes = staged(messages.select(F.xxhash64(conv, F.lit(5)).alias("conv"), "conv_id", "node", "parent", "role", "text", "score"), "reply-nodes")
    tables, rooted = _pointers(nodes)
    inner = nodes.where("parent IS NOT NULL").select("conv", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(inner, ["conv", "node"], "left_anti")
    rank = Window.partitionBy("conv").orderBy(F.desc("total"), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(rank))
    marks = (ranked if branches is None else ranked.where(F.col("branch") <= branches)).select("conv", "branch", "node")
    for pointers in reversed(tables):
        marks = staged(marks, "reply-marks")  # used twice: a plan that is not cut would double with each step
        marks = marks.unionByName(marks.join(pointers, ["conv", "node"]).select("conv", "branch", F.col("up").alias("node")))
    marks = marks.distinct().join(rooted, ["conv", "node"]).join(nodes, ["conv", "node"])
    return marks.select("conv_id", "branch", "depth", "role", "text")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    """Exact inverse of :func:`escape` (and of the line feed in roles): escapes are split off from the left."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def format_paths(paths: DataFrame) -> DataFrame:
    """``conv_id, branch, formatted, loss_mask``: one row per path; the mask is ``array<struct<start, length>>`` of code points."""
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turn = paths.select("conv_id", "branch", "depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    turns = F.array_sort(F.collect_list(F.struct("depth", "head", "body", "loss")))
    whole = turn.groupBy("conv_id", "branch").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n" + _TURN_END))), "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start, length = acc["at"] + F.char_length(t["head"]), F.char_length(t["body"])
        span = F.when(t["loss"], F.array(F.struct(start.alias("start"), length.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + length + 1 + len(_TURN_END)).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    mask = F.aggregate("turns", empty, step, lambda acc: acc["spans"])
    return whole.select("conv_id", "branch", text.alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    chunks = F.split(formatted, "\n" + _TURN_END, -1)
    full = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    return F.transform(full, lambda c: F.struct(
        unescape(F.substring_index(F.substr(c, F.lit(5)), "\n", 1)).alias("role"),
        unescape(F.substr(c, F.instr(c, "\n") + 1)).alias("text"),
    ))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
