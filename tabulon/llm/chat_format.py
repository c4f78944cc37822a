"""Reply trees formatted as chats: self-joins find root-to-leaf paths, the best branches become conversations.

DataFrame functions only. Template of a turn: ``<|role|>\\ntext</s>\\n``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END = "</s>\n"


def escape(x: Column) -> Column:
    """Double backslashes, then put one after the first character of each control string."""
    x = F.regexp_replace(x, r"\\", r"\\\\")
    return F.regexp_replace(x, r"([<\[|])(s>|/s>|INST\]|/INST\]|\||>)", r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees (tree, node, parent, role, text, score): each turn answers the one before.

    Rows are put in order by turn (null first), then role and text; repeated rows stay. Null conv_id is
    one conversation. Null roles and texts are empty.
    """
    texts = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("t").asc_nulls_first(), "role", "text")).cast("long")
    return texts.withColumn("node", n).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def branches(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, place, rank, node) of the chosen root-to-leaf paths.

    nodes: tree, node (unique in its tree), parent (null or unknown: a root), score (null: 0). A branch
    scores the mean of its nodes; equal ones rank by longer path, then smaller leaf. per_tree None takes
    all. Each join doubles the distance to the ancestor, so a path of d turns takes log2 d joins. Nodes
    that only lead into a cycle are cut off and stand as roots.
    """
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("known"))
    step = base.alias("a").join(known.alias("b"), same("a", "b") & (F.col("a.parent") == F.col("b.known")), "left")
    state = cut(step.select("a.tree", "a.node", F.col("b.known").alias("up"), F.lit(1).alias("depth"), "a.score"))
    total, first = state.count(), state
    done, active, links = [state.where("up is null")], state.where("up is not null"), []
    while not active.isEmpty() and 2 ** len(links) <= total:
        links.append(active)
        known = reduce(DataFrame.union, done, active)
        nxt = active.alias("a").join(known.alias("b"), same("a", "b") & (F.col("a.up") == F.col("b.node")))
        state = cut(nxt.select("a.tree", "a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.score") + F.col("b.score")).alias("score")))
        done, active = [*done, state.where("up is null")], state.where("up is not null")
    if not active.isEmpty():  # in or below a cycle
        loose = active.select("tree", "node")
        fixed = cut(nodes.alias("n").join(loose.alias("l"), same("n", "l") & (F.col("n.node") == F.col("l.node")), "left").select("n.tree", "n.node", F.when(F.col("l.node").isNull(), F.col("n.parent")).alias("parent"), "n.score"))
        return branches(fixed, per_tree)
    up = reduce(DataFrame.union, done)
    inner = first.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = up.alias("a").join(inner.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if per_tree is not None:
        leaves = leaves.where(F.col("rank") <= per_tree)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("place"))
    for k in range(len(links) - 1, -1, -1):
        jump = links[k].select("tree", "node", "up")
        both = paths.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node")), "left")
        here = F.struct(F.col("a.node").alias("node"), F.col("a.place").alias("place"))
        above = F.struct(F.col("b.up").alias("node"), (F.col("a.place") - 2**k).alias("place"))
        each = F.explode(F.when(F.col("b.up").isNull(), F.array(here)).otherwise(F.array(here, above)))
        paths = both.select("a.tree", "a.leaf", "a.rank", each.alias("x")).select("tree", "leaf", "rank", "x.node", "x.place")
    out = cut(paths)
    return out


def format_chats(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans (array of start, end in code points): one row per chosen branch.

    loss_spans cover the escaped texts of assistant turns. A tree without rows has no result. The turns
    of one branch meet in one row, since they make one string; a branch is as long as one conversation.
    """
    nodes = cut(nodes)
    same = F.col("p.tree").eqNullSafe(F.col("n.tree")) & (F.col("p.node") == F.col("n.node"))
    turns = branches(nodes, per_tree).alias("p").join(nodes.alias("n"), same)
    head = F.concat(F.lit("<|"), escape(F.col("n.role")), F.lit("|>\n"))
    part = F.struct(F.col("p.place").alias("place"), head.alias("head"), escape(F.col("n.text")).alias("body"), (F.col("n.role") == "assistant").alias("loss"))
    rows = turns.groupBy(F.col("p.tree").alias("tree"), F.col("p.leaf").alias("leaf"), F.col("p.rank").alias("rank")).agg(F.array_sort(F.collect_list(part)).alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        start = s.at + F.length(x.head)
        end = start + F.length(x.body)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(x.loss, F.concat(s.spans, span)).otherwise(s.spans).alias("spans"))

    text = F.array_join(F.transform("t", lambda x: F.concat(x.head, x.body, F.lit(END))), "")
    return rows.select("tree", "leaf", "rank", text.alias("formatted"), F.aggregate("t", zero, add).spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats plus turns (array of role, text) and loss_text, both read from the formatted string and its spans."""
    parts = F.split(F.col("formatted"), END, -1)
    cut_at = lambda x: F.instr(x, "|>\n")
    turn = lambda x: F.struct(unescape(F.substring(x, F.lit(3), cut_at(x) - 3)).alias("role"), unescape(F.substring(x, cut_at(x) + 3, F.length(x))).alias("text"))
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start))), "")
    return chats.withColumn("turns", turns).withColumn("loss_text", loss)


def digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
