"""Chat formatting of reply trees.

Messages form trees by their parents. Root-to-leaf paths are enumerated by self-joins that double their
reach: after r rounds a leaf's path holds its nearest 2**r messages, so a chain of n messages takes
about log2(n) rounds; messages that run into a circle are found first, and no path is made of them. Branches are ranked by the mean score of their messages; the chosen ones are
formatted as one conversation each, with a loss mask over what the assistant says.

A turn is ``<|start|>role<|sep|>text<|end|>``. Inside roles and texts a backslash is doubled, and one
is put after the first character of each control string of this and other usual templates (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no text can forge a turn; dropping each backslash and
keeping the character after it restores the text.

Edge cases: a null text or role is empty. Turns that tie are ordered by role and text; repeated rows
are separate turns. A null conversation id is a conversation of its own. A parent that is not among
the conversation's messages makes a root; messages whose parents go in a circle belong to no path. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import materialise

START, MIDDLE, END = "<|start|>", "<|sep|>", "<|end|>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """Columns (conv, leaf, node, distance) of all paths from roots to leaves; ``distance`` counts from the
    leaf. ``nodes`` has (conv, node, parent); conv and node are not null and unique together."""
    nodes = materialise(nodes, "chat-nodes")
    above = nodes.select("conv", F.col("node").alias("parent"))
    up = nodes.filter("parent IS NOT NULL").join(above, ["conv", "parent"]).select("conv", "node", "parent")
    jumps = [materialise(up, "chat-jumps")]
    longest = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # A message as many steps from a root as its conversation has messages does not exist: who can still jump then
    # runs into a circle, and is known before any path is made.
    while (1 << (len(jumps) - 1)) < longest and not jumps[-1].isEmpty():
        last = jumps[-1]
        further = last.alias("a").join(
            last.alias("b"), (F.col("a.conv") == F.col("b.conv")) & (F.col("a.parent") == F.col("b.node"))
        )
        jumps.append(materialise(further.select("a.conv", "a.node", "b.parent"), "chat-jumps"))
    leaves = nodes.join(jumps[0].select("conv", F.col("parent").alias("node")).distinct(), ["conv", "node"], "left_anti")
    leaves = leaves.join(jumps[-1].select("conv", "node"), ["conv", "node"], "left_anti")
    paths = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for r, jump in enumerate(jumps[:-1]):
        longer = paths.join(jump, ["conv", "node"]).select(
            "conv", "leaf", F.col("parent").alias("node"), (F.col("distance") + (1 << r)).alias("distance")
        )
        paths = materialise(paths.union(longer), "chat-paths")
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the ``branches`` best paths of each conversation.

    ``messages`` has (conv, node, parent, role, text, score); conv is a string, not null. The result has (conv, leaf, score, n_turns, formatted,
    loss_mask): ``loss_mask`` holds (start, stop), in code points of ``formatted``, of each text that the
    assistant says. One conversation is one value, so a conversation is gathered in one task at the end.
    """
    messages = materialise(messages, "chat-messages")
    paths = reply_paths(messages.select("conv", "node", "parent"))
    steps = paths.join(messages.select("conv", "node", "score"), ["conv", "node"])
    ranked = steps.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    chosen = ranked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= branches).drop("place")
    turns = paths.join(chosen, ["conv", "leaf"]).join(messages.drop("parent", "score"), ["conv", "node"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    pieces = turns.select(
        "conv",
        "leaf",
        "score",
        (-F.col("distance")).alias("at"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("says"),
    )
    before = Window.partitionBy("conv", "leaf", "score").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(END)
    offset = F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("start", offset.cast("long")).select(
        "conv",
        "leaf",
        "score",
        F.struct(
            "at",
            F.concat("head", "body", F.lit(END)).alias("piece"),
            F.when(F.col("says"), F.struct("start", (F.col("start") + F.length("body")).alias("stop"))).alias("span"),
        ).alias("turn"),
    )
    grouped = placed.groupBy("conv", "leaf", "score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select(
        "conv",
        "leaf",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    middle = lambda p: F.instr(p, MIDDLE)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(START) + 1), middle(p) - 1 - len(START))).alias("role"),
            unescape(F.substring(p, middle(p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(
            loss_mask,
            lambda s: unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )


def linear_messages(turns: DataFrame) -> DataFrame:
    """Messages for :func:`format_trees` from (conv_id, turn, role, text): each turn answers the one before it."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = turns.withColumn("conv", conv).withColumn("node", F.row_number().over(order))
    return numbered.select(
        "conv",
        F.col("node").cast("long"),
        F.when(F.col("node") > 1, F.col("node").cast("long") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, read back from its formatted form."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    formatted = format_trees(linear_messages(turns.unionByName(extra)))
    loss = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss_text(F.col("formatted"), F.col("loss_mask"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return loss.select(
        F.when(F.col("conv") != "null", F.substring("conv", 2, 40)).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
