"""Chat formatting from reply trees, with DataFrame functions only.

Messages are nodes with a parent. Ancestors are found by iterative self-joins that double the distance at each round,
so a thread of n turns takes log2(n) joins. Every leaf is one branch; branches of a tree are ranked by score, and each
chosen path from root to leaf is formatted as one conversation.

Template, one mark before each turn and one after it::

    <s>[ROLE role]text</s>

``<``, ``[`` and ``\\`` of roles and texts are escaped as ``\\l``, ``\\b`` and ``\\\\``, hence no control string
(``<s>``, ``</s>``, ``[INST]``, ...) can occur inside a text and un-escaping gives the text back exactly. ``]`` ends a
role, so it is escaped in roles as ``\\e``. The loss mask covers the escaped texts of assistant turns.

Defined cases: null texts are empty, null roles are empty; rows with a null conversation form one conversation with a
null id; equal rows are separate turns (order: turn with nulls first, role, text); a node whose parent does not exist
is a root; nodes on a cycle of parents have no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialised

# Fixed values of the template.
OPEN, CLOSE, ROLE_OPEN, ROLE_CLOSE = "<s>", "</s>", "[ROLE ", "]"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit("<"), F.lit("\\l"))
    return F.replace(t, F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Undo ``escape``; double backslashes are cut out first so that they cannot pair with what follows."""
    parts = F.split(text, "\\\\\\\\", -1)
    plain = F.transform(
        parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("]"))
    )
    return F.array_join(plain, "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\e"))


def flat_threads(rows: DataFrame) -> DataFrame:
    """Nodes of a table of turns: each turn replies to the one before it in its conversation."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "role", "text", F.row_number().over(w).cast("bigint").alias("node"))
    return at.select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def _depths(nodes: DataFrame) -> list[DataFrame]:
    """Jump tables: in table i, each node with its ancestor 2**i levels up (null above the root), its depth so far, and its root
    once that is known."""
    here = nodes.alias("c").join(
        nodes.alias("p"), F.col("c.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("c.parent") == F.col("p.node")), "left"
    )
    step = here.select(
        F.col("c.conv_id").alias("conv_id"), F.col("c.node").alias("node"), F.col("p.node").alias("up"),
        F.col("p.node").isNotNull().cast("bigint").alias("depth"), F.when(F.col("p.node").isNull(), F.col("c.node")).alias("root"),
    )
    tables = [materialised(step)]
    n = nodes.count()
    # A thread has at most n levels; if pointers are still open after that, they run in a cycle. Only nodes whose pointer
    # is open take part in a round, and most threads are short.
    while 2 ** len(tables) <= 2 * n and not tables[-1].where("up is not null").isEmpty():
        t = tables[-1]
        a, b = t.where("up is not null").alias("a"), t.alias("b")
        up = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.up") == F.col("b.node")))
        farther = up.select(
            F.col("a.conv_id").alias("conv_id"), F.col("a.node").alias("node"), F.col("b.up").alias("up"),
            (F.col("a.depth") + F.col("b.depth")).alias("depth"), F.col("b.root").alias("root"),
        )
        tables.append(materialised(farther.unionByName(t.where("up is null"))))
    return tables


def branches(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """``conv_id, branch, node, depth``: the nodes of the ``per_tree`` best branches of each tree.

    A branch is named by its leaf. Branches are ranked by the leaf's score, then by depth, both descending, then by the
    smaller leaf. ``nodes`` has conv_id, node (unique in its conversation), parent and score.
    """
    nodes = materialised(nodes.select("conv_id", "node", "parent", "score"))
    jumps = _depths(nodes)
    full = jumps[-1].where("up is null").select("conv_id", "node", "depth", "root")
    parents = nodes.where("parent is not null").select(F.col("conv_id").alias("p_conv"), F.col("parent").alias("p_node")).distinct()
    leaf = full.join(parents, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("node") == F.col("p_node")), "left_anti")
    scores = nodes.select(F.col("conv_id").alias("s_conv"), F.col("node").alias("s_node"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = leaf.join(scores, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("node") == F.col("s_node")))
    rank = F.row_number().over(W.partitionBy("conv_id", "root").orderBy(F.desc("score"), F.desc("depth"), "node"))
    path = scored.withColumn("_rank", rank).where(F.col("_rank") <= per_tree).select("conv_id", F.col("node").alias("branch"), "node")
    # From the farthest jump to the nearest, each round adds the nodes that lie that far above those found.
    for t in reversed(jumps[:-1]):
        j = t.where("up is not null").select(F.col("conv_id").alias("j_conv"), F.col("node").alias("j_node"), "up")
        above = path.join(j, F.col("conv_id").eqNullSafe(F.col("j_conv")) & (F.col("node") == F.col("j_node")), "left")
        both = F.explode(F.array_compact(F.array("node", "up")))
        path = above.select("conv_id", "branch", both.alias("node"))
    d = full.select(F.col("conv_id").alias("d_conv"), F.col("node").alias("d_node"), "depth")
    return path.join(d, F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("node") == F.col("d_node"))).select(
        "conv_id", "branch", "node", "depth"
    )


def format_threads(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """``conv_id, branch, formatted, loss_spans``: one row per chosen branch.

    ``loss_spans`` is an array of (start, end) in code points of ``formatted``, end exclusive, one per assistant turn.
    """
    chosen = branches(nodes, per_tree)
    texts = nodes.select(
        F.col("conv_id").alias("t_conv"), F.col("node").alias("t_node"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = chosen.join(texts, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("node") == F.col("t_node"))).select(
        "conv_id", "branch", "depth",
        F.concat(F.lit(OPEN + ROLE_OPEN), escape_role(F.col("role")), F.lit(ROLE_CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    )
    whole = turn.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "learned"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    lengths = F.transform(
        "turns", lambda t: F.struct(F.length(t["head"]).cast("bigint").alias("h"), F.length(t["body"]).cast("bigint").alias("b"), t["learned"].alias("l"))
    )
    end = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    folded = F.aggregate(
        lengths,
        end,
        lambda acc, t: F.struct(
            (acc["at"] + t["h"] + t["b"] + len(CLOSE)).alias("at"),
            F.when(
                t["l"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["h"]).alias("start"), (acc["at"] + t["h"] + t["b"]).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return whole.select("conv_id", "branch", formatted.alias("formatted"), folded["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text, by order) and ``loss_text`` parsed from ``formatted`` and ``loss_spans``."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    head = len(OPEN + ROLE_OPEN) + 1
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(head)), ROLE_CLOSE, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ROLE_CLOSE) + 1)).alias("text"),
        ),
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest of the contract, taken from what ``read_back`` finds."""
    back = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
