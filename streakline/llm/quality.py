"""Quality rules: distribution divergence of documents from references of their language.

Two histograms describe a text: its characters by class, and its words over a
language's common words with one bin for all others. References are the sums of
these histograms over all documents that declare the language (one grouped
aggregation; the number of bins is fixed, so only a few numbers leave the
cluster). A document is compared with its language's references by the
Jensen-Shannon distance (base 2, 0 to 1); too far in either fails it. Short
texts say little about a distribution, so a distance counts only from
``MIN_CHARS`` characters or ``MIN_WORDS`` words on, and the limit for characters
is wider by ``CHAR_NOISE`` over the square root of their number, the spread that
chance alone gives.

Results: one row per input row, repeated rows and null ids included. Null text:
no words, so ``base_failed``. Languages without a word list, and null, are
compared with the reference over all documents, characters only. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.shared import map_arrow

MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.15
CHAR_NOISE = 2.2
MAX_WORD_DISTANCE = 0.55
_U = np.uint64

# Common function words of each language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be this by at from or an which you have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split(),
}
_ANY = "*"

# Character classes by byte: continuation bytes of UTF-8 belong to their lead byte.
_CLASSES = 15
_CLASS = np.zeros(256, np.int64)
_CLASS[0x80:0xC0] = -1
_CLASS[ord("a"):ord("z") + 1] = 1
for _c in b"aeiou":
    _CLASS[_c] = 2
_CLASS[ord("A"):ord("Z") + 1] = 3
_CLASS[ord("0"):ord("9") + 1] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 7
_CLASS[[ord(c) for c in "[]{}\\/=+_@~^`"]] = 8
_CLASS[0xC2] = 9    # Latin-1 punctuation
_CLASS[0xC3] = 10   # Latin-1 letters
_CLASS[0xC4:0xE0] = 11
_CLASS[0xE0:0xF0] = 12
_CLASS[0xF0:0x100] = 13
_CLASS[ord("|")] = 14
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _word_bins() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language: sorted hashes of its common words and the bin of each."""
    out = {}
    for lang, words in COMMON.items():
        block = next(tb.blocks(pa.array(list(dict.fromkeys(words)))))
        h = block.span_hash(block.prefix(), block.offs[:-1], block.offs[1:])
        o = np.argsort(h)
        out[lang] = (h[o], o)
    return out


def _sum_rows(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[offs[1:]] - c[offs[:-1]]


class Measures:
    """Counts and histograms of a block's rows."""

    def __init__(self, block: tb.Block, langs: list, bins, k: int = 8):
        data, rows = block.data, block.rows
        sep = tb.separators("space")
        starts, ends, woffs = block.words(sep)
        cls = _CLASS[data]
        lead = cls >= 0
        row_of = np.repeat(np.arange(rows), np.diff(block.offs))
        self.n_words = np.diff(woffs)
        self.chars = _sum_rows(lead, block.offs)
        self.word_chars = _sum_rows(lead & ~sep[data], block.offs)
        self.n_symbols = _sum_rows(_SYMBOL[data], block.offs)
        self.classes = np.bincount(row_of[lead] * _CLASSES + cls[lead], minlength=rows * _CLASSES).reshape(rows, -1)
        self._lines(block, starts)
        self._repeats(block, starts, ends, woffs, k)
        low = block.lowered()
        words = low.span_hash(low.prefix(), starts, ends)
        size = max(len(b[0]) for b in bins.values()) + 1
        self.common = np.zeros((rows, size), np.int64)
        for r in range(rows):
            if langs[r] in bins:
                h, bin_ = bins[langs[r]]
                w = words[woffs[r]:woffs[r + 1]]
                at = np.minimum(np.searchsorted(h, w), len(h) - 1)
                hit = h[at] == w
                self.common[r] = np.bincount(bin_[at[hit]], minlength=size)
                self.common[r, -1] = len(w) - int(hit.sum())

    def _lines(self, block: tb.Block, word_starts: np.ndarray) -> None:
        nl = np.flatnonzero(block.data == 10)
        per = _sum_rows(block.data == 10, block.offs) + 1
        a = np.sort(np.concatenate([block.offs[:-1], nl + 1]))
        b = np.sort(np.concatenate([nl, block.offs[1:]]))
        row = np.repeat(np.arange(block.rows), per)
        said = np.searchsorted(word_starts, b) > np.searchsorted(word_starts, a)
        a, b, row = a[said], b[said], row[said]
        key = tb.mix(block.span_hash(block.prefix(), a, b) + row.astype(_U) * _U(0x9E3779B97F4A7C15))
        first = np.unique(key, return_index=True)[1]
        self.n_dup_lines = np.bincount(row, minlength=block.rows) - np.bincount(row[first], minlength=block.rows)

    def _repeats(self, block: tb.Block, starts, ends, woffs, k: int) -> None:
        words = block.span_hash(block.prefix(), starts, ends)
        at = np.flatnonzero(tb.row_windows(woffs, k))
        row = np.searchsorted(woffs, at, "right") - 1
        key = tb.mix(tb.window_hash(words, k)[at] + row.astype(_U) * _U(0x9E3779B97F4A7C15))
        o = np.argsort(key)
        same = key[o][1:] == key[o][:-1]
        twice = np.zeros(len(key), bool)
        twice[o[1:][same]] = twice[o[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + k, -1)
        self.n_repeat_words = _sum_rows(np.cumsum(edge[:-1]) > 0, woffs)


def js_distance(counts: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts to the matching row of reference counts."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = ref / np.maximum(ref.sum(1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _reference_rows(batches):
    bins = _word_bins()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        sums: dict[str, np.ndarray] = {}
        for block in tb.blocks(batch.column(1)):
            own = langs[block.lo:block.lo + block.rows]
            m = Measures(block, own, bins)
            both = np.concatenate([m.classes, m.common], 1)
            for lang in {_ANY, *own} & {_ANY, *bins}:
                pick = slice(None) if lang == _ANY else np.array([x == lang for x in own])
                sums[lang] = sums.get(lang, 0) + both[pick].sum(0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(range(len(v)), pa.int32()),
                                              pa.array(v, pa.int64())], names=["lang", "bin", "n"])


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Histogram sums over all documents, by language and over all: one small row of counts each."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = map_arrow(src, _reference_rows, "lang string, bin int, n long").groupBy("lang", "bin").agg(
        F.sum("n").alias("n")).collect()  # at most (languages with a word list + 1) x bins
    out: dict[str, np.ndarray] = {}
    width = 1 + max((r["bin"] for r in rows), default=0)
    for r in rows:
        out.setdefault(r["lang"], np.zeros(width, np.int64))[r["bin"]] = r["n"]
    return out


def _verdict_rows(refs):
    def rows(batches):
        bins = _word_bins()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for block in tb.blocks(batch.column(2)):
                own = langs[block.lo:block.lo + block.rows]
                m = Measures(block, own, bins)
                ref = np.stack([refs[x if x in bins else _ANY] for x in own])
                cd = js_distance(m.classes, ref[:, :_CLASSES])
                wd = js_distance(m.common, ref[:, _CLASSES:])
                listed = np.array([x in bins for x in own])
                far = ((m.chars >= MIN_CHARS) & (cd > MAX_CHAR_DISTANCE + CHAR_NOISE / np.sqrt(np.maximum(m.chars, 1)))) | (
                    listed & (m.n_words >= MIN_WORDS) & (wd > MAX_WORD_DISTANCE))
                bad = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.rows),
                     *(pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines,
                                                         m.n_repeat_words)),
                     pa.array(bad), pa.array(~bad & ~far),
                     pa.array(np.where(m.chars >= MIN_CHARS, cd, np.nan), from_pandas=True),
                     pa.array(np.where(listed & (m.n_words >= MIN_WORDS), wd, np.nan), from_pandas=True)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "char_distance", "word_distance"])

    return rows


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          refs: dict | None = None) -> DataFrame:
    """Counts, distances (null below the length guards) and verdict of every document."""
    refs = refs or references(docs, lang_col, text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).alias("text"))
    return map_arrow(src, _verdict_rows(refs),
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, char_distance double, "
                     "word_distance double")


def query(spark, sf_dir):
    """All documents against the references of their languages."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
