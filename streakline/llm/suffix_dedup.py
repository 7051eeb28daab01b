"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier
(in a smaller document, or earlier in the same one).

1. Anchors. Every 100-byte window of a text names the smallest hash of its
   32-byte strings as its anchor (rightmost of equals). Equal windows have equal
   anchors, so windows need comparing only where anchors are equal. Consecutive
   windows with one anchor form a context: the bytes they cover.
2. Equal contexts collapse: within an Arrow batch before the shuffle, then by a
   window over each anchor. All but the earliest are repeats as a whole. This is
   what exact copies, however many, come down to, so a hot anchor arrives with a
   row a batch and not a row a copy.
3. Contexts whose anchor has other contexts too are fetched and suffix-sorted,
   all contexts of an anchor in one chunk of bounded size. Two-stage sorting:
   only suffixes smaller than their successors are sorted directly (eight bytes
   at a time, ties only); the others are induced by scanning the buckets in
   order. Adjacent suffixes whose common prefix reaches 100 bytes are equal
   windows, and all but the earliest of a run are repeats. Anchors with more
   than ``HOT`` contexts would not fit a chunk; their windows are grouped by a
   128-bit hash instead, combined before the shuffle.
4. The spans of a document are merged and cut out.

Results: one row per input row. Null and empty texts have no bytes. Rows
without id come after all ids. Rows that share an id are told apart by their
text (hash order); repeats of one row (same id and text) are one document and
get the same result. Texts longer than a block are cut into overlapping
segments, which changes contexts but no result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.shared import Scratch, map_arrow

LENGTH = 100
GRAM = 32
HOT = 8_000
CHUNK = 1 << 19
SEGMENT = 1 << 20
_U = np.uint64
_NO_ID = 2 ** 63 - 1


# ---------------------------------------------------------------- suffix array

def _packed(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as one big-endian number; ``text`` ends in padding."""
    n = len(text) - 8
    out = np.zeros(n, _U)
    for j in range(8):
        out |= text[j:j + n].astype(_U) << _U(56 - 8 * j)
    return out


def _types(text: np.ndarray, n: int) -> np.ndarray:
    """True where the suffix is smaller than its successor; position n (padding) counts as smaller."""
    step = text[1:n + 1].astype(np.int16) - text[:n]
    at = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # next position where neighbours differ
    small = np.ones(n + 1, bool)
    small[:n] = np.where(nxt < n, step[np.minimum(nxt, n - 1)] > 0, True)
    return small


def _sort_direct(pos: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes, eight bytes a round, ties only."""
    order = pos[np.argsort(packed[pos], kind="stable")]
    key = packed[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else key.astype(np.int64)
    last = len(packed) - 1
    for d in range(8, depth, 8):
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub, g = order[tied], group[tied]
        k = packed[np.minimum(sub + d, last)]
        o = np.lexsort((k, g))
        order[tied], k = sub[o], k[o]
        fresh = np.zeros(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[tied[1:]] |= k[1:] != k[:-1]
        group = np.cumsum(fresh)
    return order


def suffix_order(text: np.ndarray, n: int, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` bytes at each; ``text`` has n bytes and padding.

    Ties may come in any order, so equal strings of ``depth`` bytes are neighbours.
    """
    packed = _packed(text)
    small = _types(text, n)
    spots = np.where(small, np.arange(n + 1), n)
    next_small = np.minimum.accumulate(spots[::-1])[::-1]
    edge = np.zeros(n + 2, np.int64)  # a start needs all suffixes up to the next one sorted directly
    np.add.at(edge, starts, 1)
    np.add.at(edge, next_small[starts] + 1, -1)
    need = np.cumsum(edge[:n + 1]) > 0
    direct = _sort_direct(np.flatnonzero(need & small), packed, depth)
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))  # direct is in order of first bytes
    large = need & ~small
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        front = np.concatenate(pushed[c]) if pushed[c] else direct[:0]
        queue = [front]
        while len(front):  # suffixes of this bucket that others of it induce: runs of one byte
            p = front[front > 0] - 1
            front = p[large[p] & (text[p] == c)]
            queue.append(front)
        bucket = np.concatenate([*queue, direct[cut[c]:cut[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[large[p] & (text[p] > c)]
        if len(p):
            b = text[p]
            o = np.argsort(b, kind="stable")
            p, b = p[o], b[o]
            heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for part, head in zip(np.split(p, heads[1:]), b[heads], strict=True):
                pushed[head].append(part)
    wanted = np.zeros(n + 1, bool)
    wanted[starts] = True
    order = np.concatenate(out) if out else starts[:0]
    return order[wanted[order]]


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each entry's common prefix with the entry before it reaches ``length`` bytes."""
    packed = _packed(text)
    same = np.zeros(len(order), bool)
    alive = np.arange(1, len(order))
    for d in [*range(0, length - 8, 8), length - 8]:
        a, b = order[alive - 1] + d, order[alive] + d
        alive = alive[packed[a] == packed[b]]
    same[alive] = True
    return same


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For contexts in order of their place: for each window of each context, whether an equal one is earlier."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1])
    text = np.frombuffer(b"".join(contexts) + bytes(length + 16), np.uint8)
    wins = sizes - length + 1
    first = np.concatenate([[0], np.cumsum(wins)])
    starts = np.arange(first[-1]) - np.repeat(first[:-1], wins) + np.repeat(base[:-1], wins)
    order = suffix_order(text, n, starts, length)
    run = np.cumsum(~long_prefixes(text, order, length)) - 1
    earliest = np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])))
    again = np.zeros(n, bool)
    again[order] = order != earliest[run]
    return again[starts]


# ---------------------------------------------------------------- anchors

def _segments(block: tb.Block):
    """(block, row, byte offset in the row) pieces of bounded size; a long text overlaps by LENGTH - 1."""
    if len(block.data) <= 2 * SEGMENT:
        yield block, None, 0
        return
    for r in range(block.rows):
        a, b = int(block.offs[r]), int(block.offs[r + 1])
        for at in range(a, max(b - LENGTH + 1, a + 1), SEGMENT):
            part = block.data[at:min(b, at + SEGMENT + LENGTH - 1)]
            yield tb.Block(part, np.array([0, len(part)]), 0), r, at - a


def anchored(block: tb.Block):
    """Contexts of a block: (anchor hash, context hash, row, start in the block, length)."""
    n = len(block.data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z.astype(_U), z, z, z
    pre = block.prefix()
    inv = tb.powers(n + 1)[1]
    grams = tb.mix((pre[GRAM:] - pre[:-GRAM]) * inv[:n - GRAM + 1])
    bits = _U(max(1, n.bit_length()))
    mask = (_U(1) << bits) - _U(1)
    key = (grams & ~mask) | (mask - np.arange(len(grams), dtype=_U))
    low = tb.sliding_min(key, LENGTH - GRAM + 1)
    edge = np.zeros(n + 1, np.int64)
    size = np.diff(block.offs)
    fit = np.flatnonzero(size >= LENGTH)
    edge[block.offs[fit]] += 1
    np.add.at(edge, block.offs[fit + 1] - LENGTH + 1, -1)
    s = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z.astype(_U), z.astype(_U), z, z, z
    anchor = (mask - (low[s] & mask)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)]))
    tail = np.append(head[1:], len(s)) - 1
    start, end = s[head], s[tail] + LENGTH
    ctx = block.span_hash(block.prefix(1), start, end)
    row = np.searchsorted(block.offs, start, "right") - 1
    return grams[anchor[head]], ctx, row, start, end - start


_ANCHORS = "h long, c long, doc long, t long, start int, len int, again boolean"


def _anchor_rows(batches):
    for batch in batches:
        doc = np.asarray(batch.column(0).fill_null(_NO_ID))
        t = np.asarray(batch.column(1))
        cols = [[] for _ in range(5)]
        for block in tb.blocks(batch.column(2)):
            for piece, r, at in _segments(block):
                h, c, row, start, size = anchored(piece)
                own = row if r is None else np.full(len(row), r)
                rel = start - piece.offs[row] + at
                for col, x in zip(cols, (h, c, own + block.lo, rel, size), strict=True):
                    col.append(x)
        if not cols[0]:
            continue
        h, c, row, rel, size = map(np.concatenate, cols)
        d, tt = doc[row], t[row]
        # earliest of equal contexts first; the others of the batch are repeats and need no company
        o = np.lexsort((rel, tt, d, c, h))
        again = np.zeros(len(o), bool)
        again[o[1:]] = (h[o[1:]] == h[o[:-1]]) & (c[o[1:]] == c[o[:-1]])
        spread = tb.mix(np.arange(len(h), dtype=_U) ^ (d.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)))
        h = np.where(again, spread, h)
        for a in range(0, len(h), 100_000):
            z = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[z].view(np.int64)), pa.array(c[z].view(np.int64)), pa.array(d[z]), pa.array(tt[z]),
                 pa.array(rel[z].astype(np.int32)), pa.array(size[z].astype(np.int32)), pa.array(again[z])],
                names=["h", "c", "doc", "t", "start", "len", "again"])


# ---------------------------------------------------------------- jobs

def _context_rows(batches):
    """(text, wanted contexts) -> one row a context with its bytes."""
    for batch in batches:
        doc, t, text, want = (batch.column(i) for i in range(4))
        for i in range(len(batch)):
            data = memoryview(text[i].as_buffer())
            w = want[i].values
            h, s, n, hot = (w.field(j).to_numpy(zero_copy_only=False) for j in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.full(len(h), doc[i].as_py())), pa.array(np.full(len(h), t[i].as_py())),
                 pa.array(s), pa.array([bytes(data[a:a + b]) for a, b in zip(s, n, strict=True)], pa.binary()),
                 pa.array(hot)], names=["h", "doc", "t", "start", "ctx", "hot"])


def _runs(doc, t, start, sizes, again):
    """Spans [a, b) of repeated windows, as a batch."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    own = np.repeat(np.arange(len(sizes)), sizes)
    off = np.arange(first[-1]) - first[own]
    at = np.flatnonzero(again)
    new = np.concatenate([[True], (np.diff(at) != 1) | (own[at[1:]] != own[at[:-1]])]) if len(at) else again[:0]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at))[:len(head)] - 1
    i, j = at[head], at[tail]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[own[i]]), pa.array(t[own[i]]), pa.array((start[own[i]] + off[i]).astype(np.int32)),
         pa.array((start[own[i]] + off[j] + LENGTH).astype(np.int32))], names=["doc", "t", "a", "b"])


def _sorted_chunks(batches):
    """Suffix-sort the contexts of whole anchors, about CHUNK bytes at a time; rows come clustered by anchor."""
    held, size, last = [], 0, None

    def settle():
        doc, t, start = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
        o = np.lexsort((start, t, doc))
        ctx = [held[i][4] for i in o]
        sizes = np.array([len(x) - LENGTH + 1 for x in ctx], np.int64)
        return _runs(doc[o], t[o], start[o], sizes, repeated_windows(ctx))

    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= CHUNK and r[0] != last:
                yield settle()
                held, size = [], 0
            held.append(r)
            size, last = size + len(r[4]), r[0]
    if held:
        yield settle()


def _window_rows(batches):
    """Windows of hot anchors' contexts by two 64-bit hashes."""
    for batch in batches:
        for doc, t, start, ctx in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            data = np.frombuffer(ctx, np.uint8)
            block = tb.Block(data, np.array([0, len(data)]), 0)
            s = np.arange(len(data) - LENGTH + 1)
            g1, g2 = (block.span_hash(block.prefix(k), s, s + LENGTH).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g1), pa.array(g2), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), t)),
                 pa.array((s + start).astype(np.int32))], names=["g1", "g2", "doc", "t", "a"])


def _cut_rows(batches):
    for batch in batches:
        ids, text, spans = (batch.column(i) for i in range(3))
        n, gone, runs, kept = [], [], [], []
        for i in range(len(batch)):
            buf = text[i].as_buffer() if text[i].is_valid else b""
            data = memoryview(buf) if buf is not None else b""
            parts, at, removed, count = [], 0, 0, 0
            if spans[i].is_valid:
                ab = np.sort(np.asarray(spans[i].values))  # a in the high half, b in the low half
                a, b = ab >> 32, np.maximum.accumulate(ab & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                for x, y in zip(a[new], np.append(b[new[1:] - 1], b[-1]), strict=True):
                    parts.append(data[at:x])
                    at, removed, count = int(y), removed + int(y - x), count + 1
            parts.append(data[at:])
            n.append(len(data)), gone.append(removed), runs.append(count), kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept binary) of all documents; see the module text."""
    run = Scratch(docs.sparkSession, "suffix")
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    twice = not ids.groupBy("i").count().where("count > 1").isEmpty()  # ids that need telling apart
    tie = F.coalesce(F.xxhash64(text_col), F.lit(0)) if twice else F.lit(0).cast("long")
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), tie.alias("t"),
                      F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    base = src.select("doc", "t", "text")
    by = Window.partitionBy("h").orderBy("c", "doc", "t", "start")
    anchors = (map_arrow(base, _anchor_rows, _ANCHORS)
               .withColumn("before", F.lag("c").over(by)).withColumn("after", F.lead("c").over(by))
               .withColumn("again", F.col("again") | F.coalesce(F.col("before") == F.col("c"), F.lit(False)))
               .where("again or before is not null or after is not null")
               .select("h", "doc", "t", "start", "len", "again"))
    anchors = run.keep(anchors, "anchors")
    # the earliest of each context; if an anchor has one, only repeats of it follow and it meets no other
    open_ = anchors.where("not again")
    many = open_.groupBy("h").count()
    want = (open_.join(many.where("count > 1"), "h")
            .groupBy("doc", "t").agg(F.collect_list(F.struct(
                "h", "start", "len", (F.col("count") > HOT).alias("hot"))).alias("want")))
    texts = base.where(F.octet_length("text") >= LENGTH)
    if twice:
        texts = texts.dropDuplicates(["doc", "t"])
    ctx = map_arrow(texts.join(want, ["doc", "t"]).select("doc", "t", "text", "want"), _context_rows,
                    "h long, doc long, t long, start int, ctx binary, hot boolean")
    ctx = run.keep(ctx, "contexts")
    plain = ctx.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h")
    spans = map_arrow(plain, _sorted_chunks, "doc long, t long, a int, b int")
    wins = map_arrow(ctx.where("hot").drop("hot"), _window_rows, "g1 long, g2 long, doc long, t long, a int")
    least = wins.groupBy("g1", "g2").agg(F.min(F.struct("doc", "t", "a")).alias("first"))
    hot = (wins.join(least, ["g1", "g2"]).where(F.struct("doc", "t", "a") != F.col("first"))
           .select("doc", "t", "a", (F.col("a") + LENGTH).alias("b")))
    whole = anchors.where("again").select("doc", "t", F.col("start").alias("a"), (F.col("start") + F.col("len")).alias("b"))
    cut = (whole.unionByName(spans).unionByName(hot).groupBy("doc", "t").agg(F.collect_list(
        F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("spans")))
    out = src.join(cut, ["doc", "t"], "left").select("doc_id", "text", "spans")
    return map_arrow(out, _cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir):
    """Repeated strings of 100 bytes cut out of all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
