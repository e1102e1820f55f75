"""Chat formatting of reply trees: paths by self-joins, branches by score, one conversation for each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, table

START, END = "<|im_start|>", "<|im_end|>"
#: Branches of each tree that the query formats.
BRANCHES = 1


def escape(text: Column) -> Column:
    r"""Texts in which no control string can stand: \ becomes \\ and <| becomes <\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    r"""As escape(); a line feed becomes \n, as the first one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """The line feeds first, where an odd number of backslashes stands before the n."""
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\([\\|])", "$1")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a tree in which each turn replies to the one before it, scored by what the assistant says in it.

    Turns of a conversation stand by turn (null first), equal ones by role and text. All rows with a null conv_id are
    one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    said = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double")
    return nodes.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", said.alias("score"))


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): each node of each root-to-leaf path, up steps above its leaf.

    messages: (conv_id, node, parent). A parent that is null, missing or the node itself makes a root; of rows that repeat a node
    the smallest parent counts. Leaves on a cycle or below one have no root, so no path. An empty table has no paths.

    Self-joins of the table of jumps over 2^r messages give that over 2^(r+1); then each path takes, from the longest
    jump to the shortest, every node that one jump leads to. A path of n nodes costs n rows and about 2 log2(n) joins.
    """
    nodes = cut(messages.groupBy("conv_id", "node").agg(F.min("parent").alias("parent")))
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    jumps = [cut(nodes.where("parent <> node").join(known, same & (F.col("parent") == F.col("n"))).select("conv_id", "node", F.col("parent").alias("to")))]
    parents = jumps[0].select(F.col("conv_id").alias("c"), F.col("to").alias("n")).distinct()
    leaves = nodes.join(parents, same & (F.col("node") == F.col("n")), "left_anti").select("conv_id", F.col("node").alias("leaf"))
    while jumps[-1].limit(1).count():
        on = jumps[-1].select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("to").alias("far"))
        jumps.append(cut(jumps[-1].join(on, same & (F.col("to") == F.col("n"))).select("conv_id", "node", F.col("far").alias("to"))))
        if 1 << (len(jumps) - 1) >= most:  # who still jumps has met itself
            endless = jumps[-1].select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
            leaves = leaves.join(endless, same & (F.col("leaf") == F.col("n")), "left_anti")
            break
    paths = cut(leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for r in range(len(jumps) - 2, -1, -1):
        on = jumps[r].select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "to")
        over = paths.join(on, same & (F.col("node") == F.col("n"))).select("conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << r)).alias("up"))
        paths, old = cut(paths.union(over)), paths
        release(old)
    release(*jumps)
    return paths


def best_branches(paths: DataFrame, messages: DataFrame, keep: int) -> DataFrame:
    """The paths of the `keep` branches of each tree with the highest sums of scores; null counts 0, ties go by leaf.

    Sums are pre-aggregated, and of a tree's branches no more than `keep` leave a task before they are ranked.
    """
    scores = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    sums = paths.join(scores, same & (F.col("node") == F.col("n"))).groupBy("conv_id", "leaf").agg(F.sum("score").alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= keep).select(F.col("conv_id").alias("c"), F.col("leaf").alias("n"))
    return paths.join(best, same & (F.col("leaf") == F.col("n")), "left_semi")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, formatted, loss): each path as one text; loss: spans (start, chars) of the assistants' texts in it.

    messages: (conv_id, node, role, text); null roles and texts count as empty. Of messages that repeat conv_id and
    node each stands in the path, by role and text. Spans count code points.
    """
    steps = paths.select("conv_id", "leaf", (-F.col("up")).alias("pos"), F.col("node").alias("n"))
    at = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n_"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    steps = steps.join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("n_")))
    steps = steps.select(
        "conv_id", "leaf",
        F.struct("pos", "role", "text", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("turn"),
    )
    turns = steps.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,chars:bigint>>)").alias("spans"))
    spans = F.aggregate(
        "turns", start,
        lambda x, t: F.struct(
            (x.at + F.length(t.head) + F.length(t.body) + len(END) + 1).cast("long").alias("at"),
            F.when(t.role == "assistant", F.concat(x.spans, F.array(F.struct((x.at + F.length(t.head)).cast("long").alias("start"), F.length(t.body).cast("long").alias("chars")))))
            .otherwise(x.spans).alias("spans"),
        ),
        lambda x: x.spans,
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END + "\n"))), "")
    return turns.select("conv_id", "leaf", text.alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, leaf, turns, loss_text): the turns (role, text) and the text under the loss mask, from the output alone."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)
    head = F.transform(parts, lambda p: F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1))
    rows = formatted.select("conv_id", "leaf", "formatted", "loss", parts.alias("parts"), head.alias("heads"))
    turns = F.transform(
        F.arrays_zip("parts", "heads"),
        lambda x: F.struct(unescape_role(x.heads).alias("role"), unescape(F.substr(x.parts, F.length(x.heads) + len(START) + 2)).alias("text")),
    )
    loss = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.chars.cast("int")))
    return rows.select("conv_id", "leaf", "formatted", turns.alias("turns"), F.array_join(F.transform(loss, unescape), "").alias("loss_text"))


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    tree = linear_tree(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))
    done = read_back(format_paths(tree, best_branches(root_to_leaf_paths(tree), tree, BRANCHES)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
said AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 12 + 1 + 11
         + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS chars FROM all_turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM whole
"""
