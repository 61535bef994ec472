"""Chat formatting of reply trees with DataFrame operations only.

A table of nodes (tree, node, parent, role, text, score) holds one row per message. Iterative self-joins by pointer
doubling give every node its depth and path score and, for the chosen leaves, the path from the root: round k joins the
table of 2^k-th ancestors with itself, so a tree of depth d takes about log2(d) joins and no row ever holds a path.
Leaves are ranked within their tree by path score, then depth, then node id; each of the `best` first is formatted as
one conversation with the character spans of the loss mask.

Template: `<|turn|>role<|text|>text<|end|>\\n` a turn. Inside roles and texts a backslash is doubled and `<|` becomes
`<\\|`, so no marker can occur in them and unescaping is exact.

Edge cases: null role or text is the empty string; a null tree id is one tree; a parent that is null or absent makes a
root; nodes on a cycle reach no root and are left out; rows that share a position are ordered by role and text; an empty
table gives an empty result; extra columns are ignored. One conversation is one output string, so a single
conversation must fit a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TRICKY = "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes with depth and path score, the tables of 2^k-th ancestors, of the nodes that have one). Nodes that reach no root are left out."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    base = nodes.select("tree", "node", "parent", "score")
    rooted = base.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("anc"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")
    )
    level = materialize(rooted, "anc")
    rows, k = level.count(), 0
    open_, done = level.where("anc is not null"), level.where("anc is null")
    levels = [open_]
    while (1 << k) <= rows and open_.limit(1).count():
        # Nodes that have met their root are done and joined no more.
        up = open_.unionByName(done).select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        jumped = open_.join(up, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        level = materialize(jumped, "anc")
        open_, done = level.where("anc is not null"), done.unionByName(level.where("anc is null"))
        levels.append(open_)
        k += 1
    return done.select("tree", "node", "depth", "total"), levels


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, total, node, depth): the root-to-leaf paths of the best leaves of every tree."""
    placed, levels = ancestors(nodes)
    leaves = placed.join(nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("depth").desc(), "node"))
    found = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "total", "node")
    for level in levels[:-1]:  # the last one has no ancestor left
        up = level.select("tree", "node", "anc")
        found = found.unionByName(found.join(up, ["tree", "node"]).select("tree", "leaf", "rank", "total", F.col("anc").alias("node")))
        found = materialize(found, "path")
    return found.join(placed.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(nodes: DataFrame, chosen: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, total, formatted, loss_spans): one conversation a path; spans are [start, end) in characters."""
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escape(F.coalesce("text", F.lit("")))
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "total", "depth", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == loss_role).alias("loss")
    )
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.col("head")
    one = F.struct("depth", "piece", F.when(F.col("loss"), F.struct(start.alias("start"), (start + F.col("body")).alias("end"))).alias("span"))
    grouped = turns.withColumn("one", one).groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("total").alias("total"), F.array_sort(F.collect_list("one")).alias("turns"))
    return grouped.select(
        "tree", "leaf", "rank", "total", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans")
    )


def format_trees(nodes: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    return format_paths(nodes, paths(nodes, best), loss_role)


def chain(conversations: DataFrame) -> DataFrame:
    """Nodes of linear conversations (conv_id, turn, role, text): each row replies to the row before it."""
    tree = F.when(F.col("conv_id").isNull(), F.lit("null")).otherwise(F.concat(F.lit("id"), F.col("conv_id").cast("string")))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = conversations.select("conv_id", "turn", "role", "text").withColumn("node", at.cast("long"))
    return nodes.select("conv_id", tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted strings alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: F.length(p) > 0)
    role = lambda p: unescape(F.substring_index(p, TEXT, 1))
    text = lambda p: unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select(
        "tree",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    nodes = materialize(chain(convs.unionByName(added)), "nodes")
    out = digest(format_trees(nodes))
    return out.select(F.when(F.col("tree") != "null", F.substring("tree", 3, 40).cast("long")).alias("conv_id"), *out.columns[1:])


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, x.t, x.r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
