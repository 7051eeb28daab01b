"""Conversation prefix trie: shared beginnings of conversations as a tree, with totals of every subtree.

A node is a distinct sequence of first turns; its key is a 128-bit hash chained
along the conversation. Rows of (conversation, depth) are made by one streaming
pass over conversations sorted by turn (no conversation is held whole) and meet
per node in a grouped aggregation, which combines before the shuffle, so a first
turn that a third of all conversations share is a few rows.

Subtree totals by time-forward processing. ``K`` is the least depth (1 or more)
from which on no node that branches has more than ``shard_rows`` nodes below it. Each node of depth ``K`` and all below it lie in one shard. Spark sorts the
shards' nodes in reverse level order (deepest first; an external sort), and one
pass takes each node's messages out of a priority queue, adds them to its own
values and puts its totals into the queue for its parent. The queue keeps at
most ``QUEUE_ROWS`` messages in memory and spills sorted runs. The totals that
shard roots send to nodes above ``K`` go across shards: level by level, each a
sum per parent that combines before the shuffle, so no node's children ever meet
in one task. There is a round of Spark a level above ``K``: a few, unless many
conversations branch off one another late; a chain without branches, however
long, adds none.

Spilled runs are anonymous files of the running task, like those of Spark's own
sorts: no other task reads them, and they are gone when the task ends. A task
that is lost is run again from the written table of nodes.

A node's parent is looked up by a join on its key. Parents with more than
``1 / 1000`` of all nodes as children (at most 1000 of them) are broadcast
instead, so that no key of the shuffled join has more children than that.

Lists of conversations that end at a node are put together from chunks of
sorted ids (``CHUNK_IDS`` consecutive ids at most a chunk) and hashed as they
stream by.

Results: turns are ordered by turn (null first), equal ones by a hash of role and text;
repeated rows are turns of their own. Null role and text are empty. Rows without
a conversation belong to none and make no node. An empty table gives an empty
result (no root). Other columns are ignored. A very long conversation is a chain
in one shard, read as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.shared import Scratch, map_arrow

MIN_SHARD_ROWS = 2_000
SHARDS = 256            # least number of shards that a large input is cut into
QUEUE_ROWS = 200_000
CHUNK_IDS = 4_096
HEAVY_SHARE = 1_000
ROOT = b"\0" * 16
_OUT_ROWS = 8_192


class SpillingQueue:
    """Priority queue of fixed-size byte records, least first; spills sorted runs beyond ``limit`` records."""

    def __init__(self, record: int, limit: int = QUEUE_ROWS):
        self.record, self.limit = record, limit
        self.heap: list[bytes] = []
        self.runs: list[tuple[bytes, int, Iterator[bytes]]] = []
        self.spilled = 0

    def push(self, item: bytes) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        # Spark's own spill folder where it names one
        where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        f = tempfile.TemporaryFile(dir=where)
        f.write(b"".join(self.heap))
        f.seek(0)
        self.heap = []
        self.spilled += 1
        self._add_run(self._read(f))
        if len(self.runs) > 32:  # few open files: merge the runs into one
            f = tempfile.TemporaryFile(dir=where)
            for item in self._merged():
                f.write(item)
            f.seek(0)
            self._add_run(self._read(f))

    def _merged(self) -> Iterator[bytes]:
        while self.runs:
            first, k, rest = self.runs[0]
            yield first
            nxt = next(rest, None)
            if nxt is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (nxt, k, rest))

    def _read(self, f) -> Iterator[bytes]:
        with f:
            while part := f.read(self.record * 4096):
                for i in range(0, len(part), self.record):
                    yield part[i:i + self.record]

    def _add_run(self, rows: Iterator[bytes]) -> None:
        first = next(rows, None)
        if first is not None:
            heapq.heappush(self.runs, (first, self.spilled, rows))

    def peek(self) -> bytes | None:
        a = self.heap[0] if self.heap else None
        b = self.runs[0][0] if self.runs else None
        return b if a is None or (b is not None and b < a) else a

    def pop(self) -> bytes:
        item = self.peek()
        if self.heap and self.heap[0] is item:
            return heapq.heappop(self.heap)
        _, k, rest = self.runs[0]
        nxt = next(rest, None)
        if nxt is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (nxt, k, rest))
        return item


# ---- conversations ----------------------------------------------------------

def ordered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, i, turn_hash, chars): the turns of each conversation, numbered from 0; texts stay behind."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    t = convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(said, 1, 32)).alias("turn_hash"),
        F.length(text).cast("long").alias("chars"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    return t.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "turn_hash", "chars")


def as_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conversations with their numbers of turns, turns with their depth)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return convs, turns.select("conv_id", (F.col("i") + 1).alias("depth"), "turn_hash", "chars")


HEAD_BLOCK, HEAD_TURNS = 100, 6


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred, as the registered query asks.

    Of conversation ``c`` the first ``h`` turns (a hash of ``c``) are those of
    ``c - c % 100``. A head has at most five turns and goes to at most a hundred
    conversations.
    """
    c = F.col("conv_id")
    base = c - F.pmod(c, F.lit(HEAD_BLOCK))
    h = F.crc32(c.cast("string")) % HEAD_TURNS
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.where((F.pmod(c, F.lit(HEAD_BLOCK)) == 0) & (F.col("i") < HEAD_TURNS - 1)).select(
        c.alias("base"), "i", "turn_hash", "chars")
    head_sizes = sizes.where(F.pmod(c, F.lit(HEAD_BLOCK)) == 0).select(c.alias("base"), F.col("own").alias("there"))
    convs = sizes.withColumn("base", base).withColumn("h", h).join(head_sizes, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("kept"))
    own = turns.withColumn("h", h).where(F.col("i") >= F.col("h")).join(
        convs.select("conv_id", "taken"), "conv_id").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("depth"), "turn_hash", "chars")
    head = convs.where(F.col("taken") > 0).join(heads, "base").where(F.col("i") < F.col("taken")).select(
        "conv_id", (F.col("i") + 1).alias("depth"), "turn_hash", "chars")
    return convs.select("conv_id", (F.col("taken") + F.col("kept")).alias("n")), own.unionByName(head)


# ---- nodes ------------------------------------------------------------------

_CHAIN = "conv_id long, depth long, node binary, parent binary, chars long"


def _chain(batches) -> Iterator[pa.RecordBatch]:
    conv, key = None, ROOT
    for batch in batches:
        nodes, parents = [], []
        for c, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if c != conv:
                conv, key = c, ROOT
            parents.append(key)
            key = hashlib.blake2b(key + h, digest_size=16).digest()
            nodes.append(key)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()),
             batch.column(3)], ["conv_id", "depth", "node", "parent", "chars"])


def chains(sequences: DataFrame) -> DataFrame:
    """Node and parent of every (conversation, depth); the root has the key of 16 zero bytes."""
    # By a hash: partitioned by the column itself, a union of parts that are joined by it counts as partitioned
    # already, and adaptive execution then coalesces each part on its own, which tears conversations apart.
    s = sequences.select("conv_id", "depth", "turn_hash", "chars").repartition(F.xxhash64("conv_id")).sortWithinPartitions(
        "conv_id", "depth")
    return map_arrow(s, _chain, _CHAIN)


def node_table(convs: DataFrame, chain: DataFrame) -> DataFrame:
    """(node, parent, depth, chars, conv_id, n_convs): one row a node, the root included."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"),
                        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    return chain.unionByName(root).groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))


# ---- subtree totals ---------------------------------------------------------

_TOTALS = "node binary, parent binary, depth long, n_children long, n_leaves long, saved long"
_MSG = ">Q16sqq"  # reversed depth of the parent, parent, leaves, saved


def _forward(limit: int):
    def rows(batches):
        queue, out = SpillingQueue(struct.calcsize(_MSG), limit), []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for node, parent, depth, saved, top, _ in zip(*cols):
                children = leaves = 0
                mine = ((1 << 63) - depth).to_bytes(8, "big") + node
                while (item := queue.peek()) is not None and item[:24] == mine:
                    _, _, a, b = struct.unpack(_MSG, queue.pop())
                    children, leaves, saved = children + 1, leaves + a, saved + b
                leaves = leaves or 1
                if depth > top:  # the parent is in this shard
                    queue.push(struct.pack(_MSG, (1 << 63) - depth + 1, parent, leaves, saved))
                out.append((node, parent, depth, children, leaves, saved))
                if len(out) >= _OUT_ROWS:
                    yield _totals(out)
                    out = []
        if queue.peek() is not None:
            raise RuntimeError("a shard lacks the parent of one of its nodes")
        if out:
            yield _totals(out)
    return rows


def _totals(rows: list) -> pa.RecordBatch:
    node, parent, depth, children, leaves, saved = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth), pa.array(children),
         pa.array(leaves), pa.array(saved)], ["node", "parent", "depth", "n_children", "n_leaves", "saved"])


def cut_depth(nodes: DataFrame, chain: DataFrame, convs: DataFrame, shard_rows: int) -> int:
    """The least depth from 1 on from which no node that branches has more than ``shard_rows`` nodes below it.

    The nodes below one are those that its conversations give their names to: of
    each conversation a last part of its chain.
    """
    named = nodes.where(F.col("depth") > 0).groupBy("conv_id").agg(F.min("depth").alias("first"))
    own = F.col("n") - F.greatest(F.col("depth"), F.col("first") - 1)
    below = chain.select("conv_id", "depth", "node").join(named.join(convs, "conv_id"), "conv_id").where(own > 0)
    sizes = below.groupBy("node").agg(F.first("depth").alias("depth"), F.sum(own).alias("size"),
                                      F.count(F.lit(1)).alias("chains"))
    deep = sizes.where((F.col("size") > shard_rows) & (F.col("chains") > 1)).agg(F.max("depth")).first()[0]
    return 1 if deep is None else deep + 1


def subtree_totals(nodes: DataFrame, chain: DataFrame, convs: DataFrame, run: Scratch,
                   shard_rows: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(node, parent, depth, n_children, n_leaves, saved) of every node; the inputs are written tables."""
    if shard_rows is None:
        shard_rows = max(MIN_SHARD_ROWS, nodes.count() // SHARDS)
    k = cut_depth(nodes, chain, convs, shard_rows)
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    # a node's shard root: the node of depth k of the conversation it is named after
    roots = chain.where(F.col("depth") == k).select("conv_id", F.col("node").alias("shard"))
    deep = nodes.where(F.col("depth") >= k).join(roots, "conv_id").select(
        "node", "parent", "depth", own, F.lit(k).cast("long").alias("top"), "shard")
    sorted_ = deep.repartition("shard").sortWithinPartitions(F.desc("depth"), "node")
    done = run.keep(map_arrow(sorted_, _forward(queue_rows), _TOTALS), "shards")
    parts, last = [done], done.where(F.col("depth") == k)
    for d in range(k - 1, -1, -1):  # across shard roots
        sent = last.groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        level = nodes.where(F.col("depth") == d).select("node", "parent", "depth", own).join(sent, "node", "left")
        last = run.keep(level.select(
            "node", "parent", "depth", F.coalesce("c", F.lit(0)).alias("n_children"),
            F.coalesce("l", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), f"level{d}")
        parts.append(last)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parent_ids(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(node, parent_conv_id) of every node but the root."""
    many = max(1, totals.count() // HEAVY_SHARE)
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # children sum up to all nodes but one, so at most HEAVY_SHARE parents have more than `many`
    heavy = totals.where(F.col("n_children") > many).select(F.col("node").alias("parent"))
    few = named.join(F.broadcast(heavy), "parent", "left_semi")
    child = nodes.where(F.col("depth") > 0).select("node", "parent").join(
        F.broadcast(few.withColumnRenamed("parent_conv_id", "heavy_conv_id")), "parent", "left")
    return child.where(F.col("heavy_conv_id").isNotNull()).select(
        "node", F.col("heavy_conv_id").alias("parent_conv_id")).unionByName(
        child.where(F.col("heavy_conv_id").isNull()).join(named, "parent").select("node", "parent_conv_id"))


# ---- conversations that end at a node ---------------------------------------

def _hashed(batches) -> Iterator[pa.RecordBatch]:
    node, digest, out = None, None, []
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if n != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= _OUT_ROWS:
            yield _digests(out)
            out = []
    if node is not None:
        out.append((node, digest.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])],
                                      ["node", "ends_sha256"])


def end_digests(convs: DataFrame, chain: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    ends = chain.join(convs, "conv_id").where(F.col("depth") == F.col("n")).select("node", "conv_id").unionByName(
        convs.where(F.col("n") == 0).select(F.lit(ROOT).alias("node"), "conv_id"))
    chunks = ends.groupBy("node", F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return map_arrow(chunks.repartition("node").sortWithinPartitions("node", "chunk"), _hashed,
                     "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, sequences: DataFrame, shard_rows: int | None = None,
                queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """The trie of ``sequences`` (conv_id, depth, turn_hash, chars) of ``convs`` (conv_id, n): one row a node."""
    run = Scratch(convs.sparkSession, "trie")
    convs = run.keep(convs, "convs")
    chain = run.keep(chains(sequences), "chain")
    nodes = run.keep(node_table(convs, chain), "nodes")
    totals = run.keep(subtree_totals(nodes, chain, convs, run, shard_rows, queue_rows), "totals")
    out = nodes.join(totals.select("node", "n_children", "n_leaves", "saved"), "node").join(
        parent_ids(nodes, totals), "node", "left").join(end_digests(convs, chain), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark, sf_dir):
    """The trie of all conversations, with heads shared by hundreds."""
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*with_shared_heads(Scratch(spark, "turns").keep(turns, "turns")))


ORACLE = r"""
WITH RECURSIVE said AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn AS no, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, turn, chars, row_number() OVER (PARTITION BY c ORDER BY no NULLS FIRST, turn) - 1 AS i FROM said),
bits AS (SELECT CAST(b AS BIGINT) AS b, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END AS r1 FROM (SELECT CAST(i AS BIGINT) AS b FROM range(256) x(i))),
r2 AS (SELECT b, CASE WHEN r1 % 2 = 1 THEN xor(r1 // 2, 3988292384) ELSE r1 // 2 END AS v FROM bits),
r3 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r2),
r4 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r3),
r5 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r4),
r6 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r5),
r7 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r6),
r8 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM r7),
ids AS (SELECT c, count(*) AS own FROM t GROUP BY c),
crc AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS p, CAST(4294967295 AS BIGINT) AS st FROM ids
        UNION ALL
        SELECT c, s, p + 1, xor(st // 256, v) FROM crc JOIN r8 ON b = xor(st % 256, CAST(ascii(substr(s, p + 1, 1)) AS BIGINT))
        WHERE p < len(s)),
h AS (SELECT c, c - c % 100 AS base, xor(st, 4294967295) % 6 AS h FROM crc WHERE p = len(s)),
seq AS (SELECT h.c, t.i AS k, t.turn, t.chars FROM h JOIN t ON t.c = h.base AND t.i < h.h
        UNION ALL SELECT h.c, t.i + 10 AS k, t.turn, t.chars FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, turn, chars FROM seq),
walk AS (
  SELECT c, CAST(0 AS BIGINT) AS d, '' AS node, '' AS parent, CAST(0 AS BIGINT) AS chars FROM h
  UNION ALL
  SELECT s.c, s.d, sha256(w.node || s.turn), w.node, s.chars FROM walk w JOIN s ON s.c = w.c AND s.d = w.d + 1),
last AS (SELECT c, max(d) AS n FROM walk GROUP BY c),
nodes AS (SELECT node, min(parent) AS parent, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs,
                 (count(*) - 1) * min(chars) AS saved
          FROM walk GROUP BY node),
ends AS (SELECT w.node, string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c) AS ids
         FROM walk w JOIN last USING (c) WHERE w.d = last.n GROUP BY w.node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
-- every node with all its ancestors: those of the conversation it is named after
up AS (SELECT x.node AS below, w.node AS above FROM nodes x JOIN walk w ON w.c = x.conv_id AND w.d <= x.depth),
tot AS (SELECT u.above AS node, sum(n.saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
        FROM up u JOIN nodes n ON n.node = u.below LEFT JOIN kids k ON k.node = u.below GROUP BY u.above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(tot.leaves AS BIGINT) AS n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN kids k ON k.node = n.node
JOIN tot ON tot.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
