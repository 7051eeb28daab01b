"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each written as one conversation.

A reply names its parent within its conversation. Paths are found by iterated
self-joins that double their reach: round ``j`` holds every node's ancestor at
distance ``2**j``, so a path of ``n`` turns takes ``log2(n)`` rounds and no
path array is built before the end. A path's score is the sum of its nodes'
scores; the ``top`` best of a conversation are written (all if None; ties by
the leaf's place).

Template. Every turn is ``<|im_start|>role``, a line feed, the text and
``<|im_end|>`` with a line feed. Control strings inside roles and texts
(``</s>``, ``<s>``, ``[INST]``, ``[/INST]`` and anything that starts ``<|``) get
a backslash after their first character, one more if backslashes stand there
already; taking one away restores them, so the output can always be read back.
The loss mask covers the texts of assistant turns.

Results: null text is empty, null role is the empty role, null score is 0. A
row without conversation or turn is placed last in its (null) conversation.
Repeated rows are turns of their own; equal turns are ordered by role and text.
A parent that does not exist makes a root; a node whose parents form a cycle
has no root and is on no path. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.shared import Scratch

_CONTROL = r"([<\[])(\\*)(/s>|s>|INST\]|/INST\]|\|)"
_CONTROL_ESCAPED = r"([<\[])(\\*)\\(/s>|s>|INST\]|/INST\]|\|)"
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_ESCAPED, "$1$2$3")


def tree_paths(nodes: DataFrame, run: Scratch, top: int | None = None) -> DataFrame:
    """Rows (conv_id, path, seq, node) of the chosen root-to-leaf paths; ``path``: its leaf.

    ``nodes``: conv_id, node, parent, score; ``node`` is unique over all conversations.
    """
    nodes = run.keep(nodes, "nodes")
    up = nodes.select("node", F.col("parent").alias("up")).join(
        nodes.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up")
    # a cycle has no leaf of its own, but a leaf may hang on one: it would climb for ever
    size = nodes.count()
    leaves = nodes.join(up.select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    on = leaves.select("conv_id", F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("back"))
    far, j = run.keep(up, "up0"), 0
    while not far.isEmpty():  # far: the ancestor at distance 2**j
        more = on.join(far, "node").select("conv_id", "path", F.col("up").alias("node"),
                                           (F.col("back") + (1 << j)).alias("back"))
        on = run.keep(on.unionByName(more), f"paths{j}")
        j += 1
        if 1 << j > size:  # farther than there are nodes: only cycles go on
            looped = far.select(F.col("node")).distinct()
            on = on.join(on.join(looped, "node").select("path").distinct(), "path", "left_anti")
            break
        nxt = far.join(far.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up")
        far = run.keep(nxt.select("node", F.col("up2").alias("up")), f"up{j}")
    if top is not None:
        score = on.join(nodes.select("node", "score"), "node").groupBy("conv_id", "path").agg(
            F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "path"))
        on = on.join(score.withColumn("rank", rank).where(F.col("rank") <= top).select("path"), "path", "left_semi")
    depth = on.groupBy("path").agg(F.max("back").alias("depth"))
    return on.join(depth, "path").select("conv_id", "path", (F.col("depth") - F.col("back")).alias("seq"), "node")


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, path, formatted, loss): one conversation a path; loss: [start, end) spans of assistant texts."""
    t = turns.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    rows = paths.join(t, "node").select(
        "conv_id", "path", "seq", one.alias("turn"), (F.col("role") == "assistant").alias("learn"),
        (F.length(F.lit(START)) + F.length(escape(F.col("role"))) + 1).alias("skip"),
        F.length(escape(F.col("text"))).alias("n"))
    whole = rows.groupBy("conv_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "turn", "learn", "skip", "n"))).alias("t"))
    spans = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["turn"])).alias("at"),
            F.when(x["learn"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + x["skip"]).alias("start"), (s["at"] + x["skip"] + x["n"]).alias("end")))))
            .otherwise(s["spans"]).alias("spans")))
    return whole.select("conv_id", "path", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
                        spans["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.lit(len(START) + 2) + F.length(F.substring_index(
            F.substr(p, F.lit(len(START) + 1)), "\n", 1)))).alias("text")))


def format_trees(msgs: DataFrame, top: int | None = None) -> DataFrame:
    """(conv_id, path, formatted, loss) of ``msgs``: conv_id, node, parent, role, text, score."""
    run = Scratch(msgs.sparkSession, "chat")
    return format_paths(tree_paths(msgs.select("conv_id", "node", "parent", "score"), run, top), msgs)


def linear(convs: DataFrame) -> DataFrame:
    """Turns in order as a tree: every turn answers the one before it.

    Turns are numbered over all rows by conversation and place, so equal turns
    stay apart; the window runs within one conversation.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    n = F.row_number().over(w)
    key = lambda i: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), i.cast("string"))
    return (convs.select("conv_id", "turn", "role", "text").withColumn("i", n)
            .select("conv_id", key(F.col("i")).alias("node"), key(F.col("i") - 1).alias("parent"),
                    "role", "text", F.lit(1.0).alias("score")))


def digests(out: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    o = out.withColumn("back", read_back(F.col("formatted")))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(
        F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return o.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def query(spark, sf_dir):
    """All conversations and one that imitates control strings, formatted and read back."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    made = spark.sql("select * from values (-1L, 0L, 'user', '{0}'), (-1L, 1L, 'assistant', '{0}') "
                     "as t(conv_id, turn, role, text)".format(said))
    return digests(format_trees(linear(convs.unionByName(made))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/s>|s>|INST\]|/INST\]|\|)', '\1\2\\\3', 'g') AS er,
             regexp_replace(text, '([<\[])(\\*)(/s>|s>|INST\]|/INST\]|\|)', '\1\2\\\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
