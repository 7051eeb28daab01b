"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents are cut into pieces of the
largest length at most and packed in shards: pieces are spread over shards of
about ``SHARD_PIECES`` by a hash, so no task sees more than that and every shard
fills its sequences nearly as well as the whole would. In a shard the longest
pieces go first. Each takes the open bin it fits most tightly; if none has room,
the least-cost size is opened: for each permitted length the cost is set against
what the shard's remaining pieces can still fill of it. At the end every bin
shrinks to the smallest permitted length that holds its contents.

Only ids and lengths are shuffled, never texts. Lengths count UTF-8 bytes and
one separator; with ``ranks`` (a tiktoken vocabulary file) they count tokens.

Results: one row per piece: bin_id, capacity and used (of the bin, after
shrinking), place (offset in the bin), doc_id, copy, piece, start, length.
Repeated rows (same id and text) are packed once each, numbered by ``copy``.
Rows without id are packed too (null doc_id). Null and empty texts have nothing
to pack and no row. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm.shared import map_arrow

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 64
#: Sequence length at which attention costs as much as all the rest of a token's work.
ATTENTION = 32768
SHARD_PIECES = 4000
#: Tasks that pack; more shards than that share tasks.
MAX_TASKS = 20_000
_SCHEMA = ("bin_id long, capacity long, used long, place long, doc_id long, t long, copy long, piece long, "
           "start long, length long")
#: Pre-tokenizer of the vocabulary files (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, attention between them, and a fixed overhead."""
    return capacity * (1 + capacity / ATTENTION) + OVERHEAD


def pack(lengths: list[int], capacities=CAPACITIES, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (lengths descending), capacity and contents of each bin."""
    caps = sorted(capacities)
    tail = np.concatenate([np.cumsum(np.array(lengths[::-1], np.int64))[::-1], [0]])  # mass from a position on
    rising = [-x for x in lengths]
    where, used, size = [], [], []
    free: list[tuple[int, int]] = []  # (room, bin), by room
    for i, n in enumerate(lengths):
        j = bisect_left(free, (n, -1))
        if j < len(free):
            room, b = free.pop(j)
        else:
            best = None
            for c in caps:
                if c >= n:
                    small = max(i + 1, bisect_left(rising, -(c - n)))  # pieces from here on fit beside it
                    score = cost(c) / min(c, n + int(tail[small]))
                    if best is None or score < best[0]:
                        best = score, c
            b, room = len(size), best[1]
            size.append(best[1])
            used.append(0)
        where.append(b)
        used[b] += n
        if room > n:
            insort(free, (room - n, b))
    return where, [next(c for c in caps if c >= u) for u in used], used


def _packed_rows(capacities):
    def settle(rows):
        shard = rows[0][0]
        where, size, used = pack([r[5] for r in rows], capacities)
        at, place = [0] * len(size), []
        for r, b in zip(rows, where, strict=True):
            place.append(at[b])
            at[b] += r[5]
        cols = list(zip(*rows, strict=True))
        out = [[(shard << 32) + b for b in where], [size[b] for b in where], [used[b] for b in where], place,
               cols[1], cols[2], cols[3], cols[4], [p * max(capacities) for p in cols[4]], cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                          names=[x.split()[0] for x in _SCHEMA.split(", ")])

    def rows(batches):
        held: list[tuple] = []
        for batch in batches:  # rows come clustered by shard
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield settle(held)
                    held = []
                held.append(r)
        if held:
            yield settle(held)

    return rows


def _token_rows(ranks):
    def rows(batches):
        import tiktoken
        enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "t", "n"])

    return rows


def lengths_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, t, n): id, text hash and length without separator; ``ranks``: path of a tiktoken vocabulary."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    if ranks is None:
        return src.select("doc_id", "t", F.octet_length("text").cast("long").alias("n"))
    with open(ranks, "rb") as f:  # read on the driver; one vocabulary is a few MB
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return map_arrow(src, _token_rows(docs.sparkSession.sparkContext.broadcast(table)), "doc_id long, t long, n long")


def best_fit(lengths: DataFrame, capacities=CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Placement of every piece; see the module text. ``lengths``: doc_id, t, n."""
    top = max(capacities)
    one = lengths.where("n > 0").groupBy("doc_id", "t", "n").agg(F.count(F.lit(1)).alias("copies"))
    count = F.ceil((F.col("n") + 1) / top)
    total = one.agg(F.sum(F.col("copies") * count)).first()[0] or 0
    shards = max(1, int(-(-total // shard_pieces)))
    pieces = (one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
              .withColumn("length", F.least(F.lit(top).cast("long"), F.col("n") + 1 - F.col("piece") * top)))
    pieces = pieces.select(F.pmod(F.xxhash64("doc_id", "t", "copy", "piece"), F.lit(shards)).alias("shard"),
                           "doc_id", "t", "copy", "piece", "length")
    order = ["shard", F.desc("length"), "doc_id", "t", "copy", "piece"]
    return map_arrow(pieces.repartition(min(shards, MAX_TASKS), "shard").sortWithinPartitions(*order), _packed_rows(list(capacities)),
                     _SCHEMA)


def pack_documents(docs: DataFrame, capacities=CAPACITIES, ranks: str | None = None) -> DataFrame:
    return best_fit(lengths_of(docs, ranks=ranks), capacities)


def sequences(placed: DataFrame) -> DataFrame:
    """One row a training sequence: its capacity, contents and pieces in order."""
    return placed.groupBy("bin_id", "capacity", "used").agg(F.array_sort(F.collect_list(F.struct(
        "place", "doc_id", "copy", "piece", "start", "length"))).alias("pieces"))


def sequence_texts(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, capacity, content binary) with byte lengths: pieces in order, a line feed after each document.

    Texts go to their bins piece by piece; a bin holds ``capacity`` bytes at most.
    """
    text = docs.select(F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__t"),
                       F.encode(F.concat(F.col(text_col), F.lit("\n")), "utf-8").alias("__b")).dropDuplicates(["__i", "__t"])
    cut = placed.join(text, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("t") == F.col("__t"))).select(
        "bin_id", "capacity", F.struct("place", F.expr("substring(__b, cast(start + 1 as int), cast(length as int))").alias("b")).alias("p"))
    parts = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"])
    return cut.groupBy("bin_id", "capacity").agg(F.aggregate(
        parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("content"))


def query(spark, sf_dir):
    """Every document's pieces, packed into sequences of 2, 4, 8 or 16 KiB."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("t")
