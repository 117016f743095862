"""Chat formatting: reply trees to conversations, with DataFrame functions only.

Paths are enumerated by iterative self-joins. A jump table maps each message to its parent; joined
with itself it maps to ancestors 2, 4, 8, ... up. From every leaf, the tables (largest first) then
double the ancestors known, so a path of depth d takes log2(d) joins and yields d rows, no more.
Branches are ranked by the mean score of their messages; each chosen path becomes one text.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts ``\\`` is written ``\\s``
and ``<`` is written ``\\a`` (in roles a line feed also, as ``\\b``), so no text can hold a mark, and
undoing the three replacements gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.scratch import stage

HEAD, BREAK, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\a"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\a"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\b"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\b"), F.lit("\n")))


def thread(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Reply-tree rows (tree, node, parent, role, text, score) of linear conversations.

    Each row answers the one before it by (turn, role, text); a null turn comes first. score is 1.
    """
    order = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = messages.select(F.col(conv).alias("tree"), F.col(turn).alias("_turn"), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long")).drop("_turn")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _same(node: str) -> Column:
    """Tree and a node column are t and n of the other side (a null tree is a tree)."""
    return F.col("tree").eqNullSafe(F.col("t")) & (F.col(node) == F.col("n"))


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of (tree, node, top), top 1, 2, 4, ... steps up; (tree, node) without end).

    Without a circle every round has fewer rows than the one before, for the rows nearest to a root
    fall out. A round that has as many holds only messages below or in a circle.
    """
    ids = messages.select("tree", "node", "parent")
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jumps = [stage(ids.where("parent IS NOT NULL").join(known, _same("parent"), "left_semi").select("tree", "node", F.col("parent").alias("top")), "jump")]
    left = jumps[0].count()
    while left:
        j = jumps[-1]
        k = j.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("top").alias("next"))
        jumps.append(stage(j.join(k, _same("top")).select("tree", "node", F.col("next").alias("top")), "jump"))
        before, left = left, jumps[-1].count()
        if left == before:
            break
    return jumps[:-1], jumps[-1].select("tree", "node")


def circular_messages(messages: DataFrame) -> DataFrame:
    """(tree, node) of the messages whose replies lead into a circle; no path of theirs has a root."""
    return jump_tables(messages)[1]


def branch_nodes(messages: DataFrame, circles: str = "raise") -> DataFrame:
    """(tree, leaf, up, node): every message of every root-to-leaf path, up steps above the leaf.

    circles: "raise" refuses messages that lead into a circle, "skip" leaves them out (what
    ``circular_messages`` gives).
    """
    ids = stage(messages.select("tree", "node", "parent"), "tree")
    jumps, endless = jump_tables(ids)
    if circles != "skip" and (n := endless.count()):
        raise ValueError(f"the replies of {n} messages form circles")
    lost = endless.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    answered = ids.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("n"))
    leaves = ids.join(answered, _same("node"), "left_anti").join(lost, _same("node"), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("up"), "node")
    for i in reversed(range(len(jumps))):
        k = jumps[i].select(F.col("tree").alias("t"), F.col("node").alias("n"), "top")
        more = paths.join(k, _same("node")).select("tree", "leaf", (F.col("up") + 2**i).alias("up"), F.col("top").alias("node"))
        paths = stage(paths.unionByName(more), "paths")
    return paths


def format_trees(messages: DataFrame, best: int | None = None, loss_role: str = "assistant", circles: str = "raise") -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, n_messages, formatted, loss_spans) of reply trees.

    messages: (tree, node, parent, role, text, score); (tree, node) is unique, a parent that is null
    or unknown makes a root, a tree may have several. A branch's score is the mean of its messages'
    scores (null: 0); ranks run from 1 by score down, ties by leaf; ``best`` keeps that many
    branches of each tree (None: all). loss_spans: 0-based start and length, in code points of
    ``formatted``, of each text of ``loss_role``. A null text or role is empty; a null tree is a tree
    of its own; extra columns are ignored; no rows give no rows; for circles of replies see
    ``branch_nodes``. Repeated (tree, node) rows must be told apart by the caller (``thread`` numbers
    rows).
    """
    rows = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    paths = branch_nodes(messages, circles)
    full = paths.join(rows, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n")
    if best is not None:
        scores = full.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
        chosen = scores.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
        full = full.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")
    body = escape(F.col("text"))
    full = full.withColumns({"head": F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(BREAK)), "body": body})
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("head") + F.length("body") + len(TAIL)
    full = full.withColumn("start", F.coalesce(F.sum(width.cast("long")).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(TAIL)).alias("piece"), (F.col("role") == loss_role).alias("learn"), "start", F.length("body").cast("long").alias("length"))
    done = full.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.avg("score").alias("branch_score"))
    spans = F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    out = done.select("tree", "leaf", "branch_score", F.size("turns").cast("long").alias("n_messages"), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
    return out.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns read back from a formatted text."""
    parts = F.split(formatted, "<\\|im_end\\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda x: F.locate(BREAK, x)
    return F.transform(parts, lambda x: F.struct(unescape_role(F.substring(x, F.lit(len(HEAD) + 1), cut(x) - 1 - len(HEAD))).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
