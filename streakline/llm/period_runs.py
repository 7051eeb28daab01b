"""Periodic run detection: maximal repetitions of words, found with a dictionary of basic factors.

Every factor of ``2**k`` words gets a name (equal factors of a text, equal
names), made by sorting the pairs of names of its two halves. For each length
``L`` the successor of an occurrence is the next one of the same name. A step to
the successor of at most ``2 * L`` words that the successor repeats (three
occurrences in arithmetic progression) proposes the step as a period. A period
``q <= L`` is extended at once: the factor is at least a period long, so ``q`` is
the smallest period there (a smaller one would be a nearer successor), and the
consecutive places with step ``q`` are the whole run but for its last
``q + L`` words. A period from ``L`` to ``2 * L`` is extended at the doubled
length, where the same holds. A run shows up again at every greater length; the
proposals are deduplicated by start and period.

A run of period ``q`` counts from ``max(6, 4 * q)`` words on, so it holds three
occurrences of every factor of the least power of two not below ``q``: none is
missed, and no two words are compared by a hash only (names are ranks of equal
values, words are compared as bytes).

Factors that occur once in their text are left behind at every doubling, so
ordinary prose ends after a few lengths. Work is per text and needs no shuffle.
Memory goes with the longest text of a block (about 1 MB of texts): some 20
times its bytes.

Results: one row per input row in its order, repeated rows and null ids
included. Null and empty texts, and texts of separators only, have no words and
no runs, and their collapsed text is empty. Of equal starts the smaller period
comes first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.shared import map_arrow

MIN_WORDS = 6
MIN_PERIODS = 4
SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal bytes."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * n + 1, np.int64)
    cuts[0], cuts[1::2], cuts[2::2] = 0, starts, ends
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 2 * n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
    words = pieces.take(pa.array(np.arange(1, 2 * n, 2)))
    return pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def find_runs(names: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start, then period.

    ``names``: the words of consecutive texts; ``offs``: word offsets of the
    texts. Runs stay within one text.
    """
    n = len(names)
    none = np.zeros(0, np.int64)
    if n < MIN_WORDS:
        return none, none, none
    sizes = np.diff(offs)
    end = np.repeat(offs[1:], sizes)
    width = int(names.max()) + 1
    at = np.arange(n)
    name = np.repeat(np.arange(len(sizes)), sizes) * width + names  # factors of two texts never share a name
    found, length, open_ = [], 1, np.zeros((0, 2), np.int64)
    whole = np.empty(n, np.int64)
    while len(at):
        order = np.argsort(name, kind="stable")
        at_o, name_o = at[order], name[order]
        same = name_o[1:] == name_o[:-1]
        gap = at_o[1:] - at_o[:-1]
        near = same & (gap <= 2 * length)
        step = np.zeros(n, np.int64)
        step[at_o[:-1][near]] = gap[near]
        # progressions of three: the successor repeats the step
        i = np.flatnonzero(step)
        third = step[i + step[i]] == step[i]
        proposed = np.stack([i[third], step[i[third]]], 1)
        here = np.concatenate([open_, proposed[proposed[:, 1] <= length]])
        open_ = proposed[proposed[:, 1] > length]
        # extension: consecutive places with one step
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1] + 1) | (step[i[1:]] != step[i[:-1]])
        group = np.cumsum(first) - 1
        lo = i[first]
        hi = i[np.append(np.flatnonzero(first)[1:], len(i)) - 1] if len(i) else i
        of = np.full(n, -1, np.int64)
        of[i] = group
        here = here[step[here[:, 0]] == here[:, 1]]
        hit = np.unique(of[here[:, 0]])
        s, q = lo[hit], step[lo[hit]]
        size = hi[hit] + length + q - s
        good = size >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
        found.append(np.stack([s[good], q[good], size[good]], 1))
        # names of factors twice as long, of places whose factor occurs again
        rank = np.cumsum(np.append(True, ~same)) - 1
        again = np.zeros(len(at_o), bool)
        again[1:] |= same
        again[:-1] |= same
        whole[:] = -1
        whole[at_o[again]] = rank[again]
        at = np.sort(at_o[again])
        at = at[at + 2 * length <= end[at]]
        second = whole[at + length]
        at, second = at[second >= 0], second[second >= 0]
        name = whole[at] * (int(rank[-1]) + 1) + second
        length *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def _planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) of a text whose words from ``a`` on repeat with period ``p``; a null id leaves its text alone."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _runs_of_batch(plant: bool):
    sep = tb.separators("space")

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in tb.blocks(batch.column(1)):
                starts, ends, offs = block.words(sep)
                names = word_names(block.data, starts, ends)
                if plant:
                    src = np.arange(len(starts))
                    for r in range(block.rows):
                        at = _planted(ids[block.lo + r], int(offs[r + 1] - offs[r]))
                        if at:
                            lo = offs[r] + at[0]
                            src[lo:offs[r + 1]] = lo + np.arange(offs[r + 1] - lo) % at[1]
                    names, starts, ends = names[src], starts[src], ends[src]
                s, size, q = find_runs(names, offs)
                # words after the first period of a run that contains them
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, s + q, 1)
                np.add.at(mark, s + size, -1)
                keep = np.cumsum(mark[:-1]) == 0
                text, cuts = _joined(block.data, starts[keep], ends[keep], _offsets(keep, offs))
                row = np.searchsorted(offs[1:], s, side="right")
                per_row = np.searchsorted(row, np.arange(block.rows + 1))
                runs = pa.StructArray.from_arrays(
                    [pa.array(s - offs[row]), pa.array(size), pa.array(q)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.lo, block.rows).cast(pa.int64()),
                    pa.array(np.diff(offs)),
                    pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), runs),
                    pa.LargeStringArray.from_buffers(block.rows, pa.py_buffer(cuts.tobytes()), pa.py_buffer(text))
                    .cast(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
    return rows


def _offsets(keep: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return total[offs]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each row's words joined by one space: bytes and row offsets."""
    size = ends - starts + 1  # a word and the space after it
    size[offs[1:][np.diff(offs) > 0] - 1] -= 1  # no space after a row's last word
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    src = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
    space = src == np.repeat(ends, size)
    src[space] = 0
    out = data[src] if len(src) else np.zeros(0, np.uint8)
    out[space] = 0x20
    return out.tobytes(), to[offs]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text; ``collapsed``: the words no run repeats, joined by a space.

    ``plant``: judge each text as the registered query asks, with the words of
    every tenth one (by a hash of its id) made periodic from some place on.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
                     _runs_of_batch(plant), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Numbers of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))), "")

    def of(x: Column, name: str) -> Column:
        return x.cast("long").alias(name)

    b = found.withColumn("best", best)
    return b.select(
        "doc_id", of(F.size("runs"), "n_runs"), of(-F.col("best.start"), "start"), of(F.col("best.length"), "length"),
        of(-F.col("best.period"), "period"),
        of(F.expr("(1000 * best.length) div (-best.period)"), "exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def query(spark, sf_dir):
    """Runs of all documents."""
    return digests(periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True))
