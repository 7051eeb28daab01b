"""Benchmark decontamination by winnowing.

The k-gram hashes of a word sequence are thinned to the minima of every window
of ``w`` of them. Any shared span of at least ``w + k - 1`` words contains a
whole window, whose minimum is chosen on both sides, so with ``k = 5`` and
``w = 6`` every shared window of ten words is met by a common fingerprint.
Fingerprints of documents are joined with those of the benchmark; each hit is
extended to all ten-word windows around it, and a window counts when its words
equal those of an item's window exactly (the words are compared, not only their
hashes). Items of fewer than ten words are one window of their own length; for
each such length that occurs, documents are probed with that length.

A benchmark of at most ``BLOCK_WORDS`` words (measured first) travels to the
tasks as one broadcast index. A larger one stays on the executors: only two
bitmaps of ``FILTER_BITS`` bits, of its fingerprints and of its windows, are
broadcast, whose size does not depend on the benchmark. Documents emit the
windows around fingerprints that the bitmaps hold, and these are joined by their
words with the items' windows, salted for passages that many documents share.
Documents are read twice then, and only their hashes are shuffled. The item ids
of one window, and those of one document, are an array in one row.

Results: one row per input row, repeated rows and rows without id included.
Null texts, empty texts and texts without words have no words and no hits.
Null or wordless items have no windows; repeated items count once by item_id;
items with a null item_id are ignored (nothing could name them). An empty
benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.shared import Scratch, free_name, map_arrow

K, W = 5, 6
SPAN = K + W - 1  # 10 words
BLOCK_WORDS = 300_000  # a benchmark of more words is joined, not broadcast
FILTER_BITS = 1 << 26  # a power of two
SALTS = 16
CHUNK = 8_192          # windows made at a time
_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def fingerprints(grams: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Positions whose k-gram is a minimum of some window of ``W`` k-grams (all of equal minima).

    ``ok`` marks the windows (by first k-gram) that lie within one row.
    """
    if len(grams) < W:
        return np.zeros(0, np.int64)
    low = tb.sliding_min(grams, W)
    chosen = np.zeros(len(grams), bool)
    n = len(low)
    for j in range(W):
        chosen[j:j + n] |= (grams[j:j + n] == low) & ok[:n]
    return np.flatnonzero(chosen)


class Index:
    """A small benchmark: sorted fingerprints, and windows by hash with their words and items."""

    def __init__(self, items: list[tuple[int, str]]):
        col = pa.array([t for _, t in items], pa.string())
        prints, wins, rows, self.words = [], [], [], []
        for block in tb.blocks(col):
            worded = _worded(block)
            prints.append(_prints(worded))
            for r, _, hashes, said in _item_windows(worded, block.rows):
                wins.extend(hashes), rows.extend([block.lo + r] * len(said)), self.words.extend(said)
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))
        order = np.argsort(np.array(wins, np.uint64), kind="stable")
        self.hashes = np.array(wins, np.uint64)[order]
        self.words = [self.words[i] for i in order]
        self.items = np.array([items[r][0] for r in rows], np.int64)[order] if rows else np.zeros(0, np.int64)
        self.short = sorted({len(x.split(b" ")) for x in self.words} - {SPAN})


def _said(data, starts, ends, at: int, size: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[at:at + size], ends[at:at + size], strict=True))


def _worded(block: tb.Block, sep=tb.separators("alnum")):
    low = block.lowered()
    starts, ends, woffs = low.words(sep)
    return low, starts, ends, woffs, low.span_hash(low.prefix(), starts, ends)


def _prints(worded) -> np.ndarray:
    """Winnowed fingerprints of all rows of a block."""
    _, _, _, woffs, words = worded
    grams, ok = tb.window_hash(words, K), tb.row_windows(woffs, SPAN)
    return grams[fingerprints(grams, ok)] if len(ok) else grams[:0]


def _item_windows(worded, n_rows: int):
    """(row, size, hashes, words) of the windows of every item, ``CHUNK`` at a time."""
    low, starts, ends, woffs, words = worded
    for r in range(n_rows):
        a, b = int(woffs[r]), int(woffs[r + 1])
        if b > a:
            size = min(SPAN, b - a)
            hashes = tb.window_hash(words[a:b], size)
            for c in range(0, len(hashes), CHUNK):
                part = hashes[c:c + CHUNK]
                yield r, size, part, [_said(low.data, starts, ends, a + c + j, size) for j in range(len(part))]


def _candidates(worded, is_print, short: list[int]):
    """(first words, hashes, size) of the windows around fingerprints that ``is_print`` accepts, and of all short ones."""
    _, _, _, woffs, words = worded
    ok = tb.row_windows(woffs, SPAN)
    if len(ok):
        grams = tb.window_hash(words, K)
        at = fingerprints(grams, ok)
        at = at[is_print(grams[at])]
        # extend each hit to the windows that hold it
        first = (at[:, None] - np.arange(W)).ravel()
        first = np.unique(first[(first >= 0) & (first < len(ok))])
        first = first[ok[first]]
        if len(first):
            seq = np.stack([words[first + j] for j in range(SPAN)])
            hashes = np.zeros(len(first), np.uint64)
            for j in range(SPAN):
                hashes += seq[j] * tb._SEQ[j]
            yield first, tb.mix(hashes + np.uint64(SPAN)), SPAN
    for size in short:
        ok = tb.row_windows(woffs, size)
        if len(ok):
            at = np.flatnonzero(ok)
            yield at, tb.window_hash(words, size)[at], size


def find(block: tb.Block, index: Index) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """(word offsets of the rows, mark of every word that is hit, items of each row)."""
    worded = _worded(block)
    low, starts, ends, woffs, words = worded
    total = len(words)
    row_of = np.repeat(np.arange(block.rows), np.diff(woffs))
    hit, items = np.zeros(total + 1, np.int64), [set() for _ in range(block.rows)]

    def is_print(grams: np.ndarray) -> np.ndarray:
        if not len(index.prints):
            return np.zeros(len(grams), bool)
        near = np.searchsorted(index.prints, grams)
        near[near == len(index.prints)] = 0
        return index.prints[near] == grams

    for at, hashes, size in _candidates(worded, is_print, index.short):
        # keep the windows whose words an item's window has
        if not len(index.hashes):
            continue
        lo = np.searchsorted(index.hashes, hashes)
        lo[lo == len(index.hashes)] = 0
        for i in np.flatnonzero(index.hashes[lo] == hashes):
            j, said = int(lo[i]), _said(low.data, starts, ends, int(at[i]), size)
            met = False
            while j < len(index.hashes) and index.hashes[j] == hashes[i]:
                if index.words[j] == said:
                    met = True
                    items[row_of[at[i]]].add(int(index.items[j]))
                j += 1
            if met:
                hit[at[i]] += 1
                hit[at[i] + size] -= 1
    return woffs, np.cumsum(hit[:total]) > 0, items


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bench.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where(
        "item is not null and text is not null").distinct()


def _small(items: DataFrame, limit: int) -> bool:
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no fewer than its words
    return size <= limit


def _index(items: DataFrame) -> Index:
    return Index([(r["item"], r["text"]) for r in items.collect()])


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each remainder of column ``hash``: bits / 8 bytes, however many rows there are."""
    at = F.pmod(F.col("hash"), F.lit(bits)) + 1
    out = np.zeros(bits // 8, np.uint8)
    for r in hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toLocalIterator():
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        lo = (r["k"] - 1) * len(m)
        out[lo:lo + len(m)] = m[:len(out) - lo]
    return out


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bench_prints(batches):
    for batch in batches:
        for blk in tb.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(_prints(_worded(blk)).view(np.int64))], names=["hash"])


def _bench_windows(batches):
    for batch in batches:
        ids = batch.column(0)
        for blk in tb.blocks(batch.column(1)):
            for r, size, hashes, said in _item_windows(_worded(blk), blk.rows):
                n = len(said)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[blk.lo + r].as_py()] * n, pa.int64()), pa.array([size] * n, pa.int32()),
                     pa.array(hashes.view(np.int64)), pa.array(said, pa.binary())], names=["item", "size", "hash", "said"])


def _doc_windows(shared):
    """Windows (t, at, size, said) that the bitmaps hold; ``at`` counts words within the text."""
    def rows(batches):
        prints, wins, short = shared.value
        for batch in batches:
            key = batch.column(0)
            for blk in tb.blocks(batch.column(1)):
                worded = _worded(blk)
                low, starts, ends, woffs, _ = worded
                for at, hashes, size in _candidates(worded, lambda g: _held(prints, g), short):
                    at = at[_held(wins, hashes)]
                    for c in range(0, len(at), CHUNK):
                        part = at[c:c + CHUNK]
                        row = np.searchsorted(woffs, part, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [key.take(pa.array(row + blk.lo)), pa.array(part - woffs[row], pa.int64()),
                             pa.array(np.full(len(part), size), pa.int32()),
                             pa.array([_said(low.data, starts, ends, int(x), size) for x in part], pa.binary())],
                            names=["t", "at", "size", "said"])

    return rows


def _word_counts(batches):
    for batch in batches:
        for blk in tb.blocks(batch.column(3)):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(blk.lo, blk.rows) for i in range(3)],
                 pa.array(np.diff(_worded(blk)[3]), pa.int64())], names=["doc_id", "t", "salt", "n_words"])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _text_key(text_col: str):
    """128 bits of a text: the hits of a document depend on nothing else."""
    return F.unhex(F.md5(F.col(text_col)))


def joined_hits(docs: DataFrame, items: DataFrame, text_col: str, bits: int) -> DataFrame:
    """(t, n_hit, items) of every text that holds a window of an item, for a benchmark of any size."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    wins = scratch.keep(map_arrow(items, _bench_windows, "item long, size int, hash long, said binary"), "windows")
    short = sorted(r[0] for r in wins.where(F.col("size") < SPAN).select("size").distinct().collect())
    shared = spark.sparkContext.broadcast((_bitmap(map_arrow(items, _bench_prints, "hash long"), bits),
                                           _bitmap(wins, bits), short))
    texts = docs.select(_text_key(text_col).alias("t"), F.col(text_col).alias("text")).where("text is not null")
    cand = map_arrow(texts, _doc_windows(shared), "t binary, at long, size int, said binary").distinct()
    owners = _salted(wins.groupBy("said").agg(F.collect_set("item").alias("items")))
    met = cand.withColumn("salt", F.pmod(F.xxhash64("t", "at"), F.lit(SALTS)).cast("int")).join(owners, ["said", "salt"])
    before = F.max(F.col("at") + F.col("size")).over(
        Window.partitionBy("t").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("at") + F.col("size")
    met = met.select("t", "items", F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.lit(0)))).alias("new"))
    return scratch.keep(met.groupBy("t").agg(
        F.sum("new").cast("long").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "hits")


def _verdicts(shared):
    def rows(batches):
        for batch in batches:
            for blk in tb.blocks(batch.column(1)):
                woffs, mark, items = find(blk, shared.value)
                cover = np.concatenate([[0], np.cumsum(mark)])
                hits = cover[woffs[1:]] - cover[woffs[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(blk.lo, blk.rows), pa.array(np.diff(woffs), pa.int64()),
                     pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                     pa.array([_digest(x) for x in items]), pa.array(hits > 0)],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  block_words: int = BLOCK_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of all documents."""
    items = _items(bench, item_col, item_text_col)
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    if _small(items, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(_index(items))
        return map_arrow(docs.select(doc_id, F.col(text_col).alias("text")), _verdicts(shared), _SCHEMA)
    hits = joined_hits(docs, items, text_col, filter_bits)
    # copies of a text are spread by the partition that read them
    src = docs.select(doc_id, _text_key(text_col).alias("t"), (F.spark_partition_id() % SALTS).alias("salt"),
                      F.col(text_col).alias("text"))
    counts = map_arrow(src, _word_counts, "doc_id long, t binary, salt int, n_words long")
    out = counts.join(_salted(hits), ["t", "salt"], "left")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(ids, F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", block_words: int = BLOCK_WORDS,
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents without a hit, all columns as they are."""
    items = _items(bench, item_col, item_text_col)
    if not _small(items, block_words):
        t, salt = free_name(docs, "t"), free_name(docs, "salt")
        hits = _salted(joined_hits(docs, items, text_col, filter_bits)).select(F.col("t").alias(t), F.col("salt").alias(salt))
        marked = docs.withColumn(t, _text_key(text_col)).withColumn(salt, F.spark_partition_id() % SALTS)
        return marked.join(hits, [t, salt], "left_anti").select(*[f"`{c}`" for c in docs.columns])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(_index(items))

    def rows(batches):
        for batch in batches:
            keep = []
            for blk in tb.blocks(batch.column(at)):
                woffs, mark, _ = find(blk, shared.value)
                cover = np.concatenate([[0], np.cumsum(mark)])
                keep.append(cover[woffs[1:]] == cover[woffs[:-1]])
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    # Arrow functions look their columns up by name, where a dot would mean a field
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return map_arrow(plain, rows, plain.schema).toDF(*docs.columns)


def query(spark, sf_dir):
    """Every document against the whole benchmark."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low),
win AS (SELECT DISTINCT id AS item_id, least(len(ws), 10) AS n, unnest(list_transform(
    range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS s
  FROM w WHERE side = 'b' AND len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE side = 'd' AND len(ws) >= n),
hits AS (SELECT d.id, d.i, d.n, win.item_id FROM (SELECT id, n, i, array_to_string(ws[i:i+n-1], ' ') AS s FROM dw) d
  JOIN win ON win.s = d.s AND win.n = d.n),
marked AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN marked USING (id) LEFT JOIN named USING (id) WHERE side = 'd'
"""
