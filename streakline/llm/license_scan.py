"""License scan by conditional compression.

1. Candidate blocks. A line that names a license, a copyright or a grant of
   rights is a candidate, with the lines around it up to the next blank line.
   A block longer than ``MAX_BLOCK`` characters is cut into overlapping blocks,
   so long texts are scanned whole in bounded steps.
2. Ranking. Each block is compressed alone and once with every template as raw
   zstandard dictionary; the share of bytes saved orders the templates.
3. Confirmation. Every template of whose words the block holds enough is
   compared word by word with the block, at each place where a run of its words
   lies that is as long as it must hold. The least number of words added,
   missing or changed (a banded edit distance) must be at most
   ``MAX_DIFFERENT`` of the template's words, and numbers (versions) must agree
   exactly. Nothing within that bound is missed.
4. Winners. The stretch of a confirmed template is compressed alone and with
   the template; the bytes saved rank the templates. Of those that overlap the
   best one within ``NOISE`` bytes of it, the one with the fewest differing
   words wins. Licenses that hold in other stretches of the block count as well.

Texts without a candidate word (decided by one pattern in the JVM) never reach
Python.

Results: one row per input row, repeated rows and null ids included. Null or
empty text: no blocks. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm.license_texts import TEMPLATES
from streakline.llm.shared import map_arrow

#: Words that make a line a candidate (the same in Java and Python).
HINT = (r"(?i)licen[cs]|copyright|permission|redistribut|free software|public domain|all rights reserved|"
        r"warrant|mozilla\.org/mpl|waived")
MAX_BLOCK = 4000
OVERLAP = 1000
MAX_DIFFERENT = 0.1
LEVEL = 3
NOISE = 16  # bytes: what a word or two in another place cost
_SCHEMA = ("doc_id long, n_blocks long, licenses string, n_confirmed long, n_different long, best_saving double, "
           "spans array<struct<license:string,start:int,end:int,different:int,saving:double>>")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_hint = re.compile(HINT)


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """[start, end) of the candidate blocks of a text."""
    out: list[tuple[int, int]] = []
    for para in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+", text):
        a, b = para.span()
        cuts = [(a, b)] if b - a <= MAX_BLOCK else [(s, min(b, s + MAX_BLOCK)) for s in range(a, b, MAX_BLOCK - OVERLAP)]
        out += [(s, e) for s, e in cuts if _hint.search(text, s, e)]
    return out


def _nearer(x: tuple[int, int]) -> tuple[int, int]:
    return -x[0], x[1]


def _overlapping(held) -> list[list[tuple]]:
    """(start, end, ..) rows in groups that overlap, directly or through others; blocks that overlap meet here as well."""
    groups, reach = [], -1
    for x in sorted(held):
        if x[0] >= reach:
            groups.append([])
        groups[-1].append(x)
        reach = max(reach, x[1])
    return groups


def _winners(group: list[tuple]) -> list[tuple]:
    """(license, start, end, different, saving) of rows (start, end, saved, different, rank, license, saving)."""
    out = []
    while group:
        top = max(group, key=lambda x: (x[2], -x[3], -x[4], -x[0]))
        near = [x for x in group if x[0] < top[1] and top[0] < x[1] and x[2] >= top[2] - NOISE]
        best = min(near, key=lambda x: (x[3], -x[2], x[4], x[0]))
        out.append((best[5], best[0], best[1], best[3], best[6]))
        group = [x for x in group if x[0] >= best[1] or best[0] >= x[1]]
    return out


class Scanner:
    """Compressors of the templates and their words."""

    def __init__(self, templates=TEMPLATES):
        import zstandard as z
        self.templates = [(name, [w for w, _, _ in words(t)]) for name, t in templates]
        self.bags = [Counter(want) for _, want in self.templates]
        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = []
        for _, t in templates:
            d = z.ZstdCompressionDict(t.encode() + b"\n", dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.given.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def savings(self, block: str) -> list[tuple[float, int]]:
        """(share saved, template), best first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, i) for i, c in enumerate(self.given)),
                      key=lambda x: (-x[0], x[1]))

    def could_hold(self, i: int, bag: Counter) -> bool:
        """Whether words that often can hold template ``i`` with at most ``MAX_DIFFERENT`` of its words missing."""
        most = MAX_DIFFERENT * len(self.templates[i][1])
        return sum(max(n - bag[w], 0) for w, n in self.bags[i].items()) <= most

    def offsets(self, i: int, spots: dict[str, list[int]]) -> list[int]:
        """Where template ``i`` may start: the places at which a long enough run of its words puts it.

        A template with ``k`` words different falls into at most ``k + 1`` runs, so one of them is no
        shorter than their average. ``spots``: the places of each word of the block.
        """
        want = self.templates[i][1]
        k = int(MAX_DIFFERENT * len(want))
        least = -(-(len(want) - k) // (k + 1))
        found, before = set(), {}
        for a, w in enumerate(want):
            now = {b: before.get(b - 1, 0) + 1 for b in spots.get(w, ())}
            found.update(b - a for b, n in now.items() if n == least)
            before = now
        return sorted(found)

    def confirm(self, i: int, have: list[str], at: int) -> tuple[int, int, int] | None:
        """(different words, first, last word of the stretch) if the block holds template ``i`` at about word ``at``.

        Edit distance of the template to any stretch of the block, within ``k`` places of ``at``: no alignment
        with at most ``k`` edits that passes ``at`` leaves that band. Of stretches as near the shortest wins.
        """
        want = self.templates[i][1]
        if have[max(at, 0):at + len(want)] == want:
            return 0, at, at + len(want) - 1
        k = int(MAX_DIFFERENT * len(want))
        never = (k + 1, 0)
        # row[j]: (edits, minus the first word) of the template so far, up to word at + words so far + j - k
        row = [(0, -p) if 0 <= p <= len(have) else never for p in range(at - k, at + k + 1)]
        for a, w in enumerate(want):
            fixed, new = w[0].isdigit(), []
            for j in range(2 * k + 1):
                p = at + a + j - k  # the word of the block beside ``w``
                best = never
                if 0 <= p < len(have):
                    if have[p] == w:
                        best = row[j]
                    elif not fixed and not have[p][0].isdigit():
                        best = (row[j][0] + 1, row[j][1])
                    if j and not have[p][0].isdigit():
                        best = max(best, (new[j - 1][0] + 1, new[j - 1][1]), key=_nearer)
                if not fixed and j < 2 * k:
                    best = max(best, (row[j + 1][0] + 1, row[j + 1][1]), key=_nearer)
                new.append(best)
            row = new
        ends = [(e, at + len(want) + j - k, -s) for j, (e, s) in enumerate(row) if e <= k]
        if not ends:
            return None
        different, end, first = min(ends, key=lambda x: (x[0], x[1] - x[2], x[1]))
        return (different, first, end - 1) if end > first else None

    def saved(self, i: int, stretch: str) -> int:
        """Bytes by which template ``i`` as a dictionary shortens a stretch."""
        data = stretch.encode()
        return len(self.plain.compress(data)) - len(self.given[i].compress(data))

    def scan(self, text: str):
        """(blocks, confirmed spans, best saving)."""
        held, best = set(), 0.0
        cand = blocks(text)
        for a, b in cand:
            block = text[a:b]
            ranked = self.savings(block)
            best = max(best, ranked[0][0])
            said = words(block)
            have = [w for w, _, _ in said]
            spots: dict[str, list[int]] = defaultdict(list)
            for k, w in enumerate(have):
                spots[w].append(k)
            bag = Counter(have)
            for rank, (saving, i) in enumerate(ranked):
                if self.could_hold(i, bag):
                    name, want = self.templates[i]
                    for hit in {self.confirm(i, have, at) for at in self.offsets(i, spots)} - {None}:
                        start, end = said[hit[1]][1], said[hit[2]][2]
                        held.add((a + start, a + end, self.saved(i, block[start:end]), hit[0], rank, name, round(saving, 6)))
        found = [x for group in _overlapping(held) for x in _winners(group)]
        return len(cand), sorted(found, key=lambda x: x[1:]), best


def _scan_rows(batches):
    scanner = Scanner()
    for batch in batches:
        out = [scanner.scan(t) if t else (0, [], 0.0) for t in batch.column(1).to_pylist()]
        spans = [[dict(zip(("license", "start", "end", "different", "saving"), s, strict=True)) for s in o[1]] for o in out]
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("different", pa.int32()), ("saving", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([o[0] for o in out], pa.int64()),
             pa.array([",".join(sorted({s[0] for s in o[1]})) for o in out], pa.string()),
             pa.array([len(o[1]) for o in out], pa.int64()),
             pa.array([sum(s[3] for s in o[1]) for o in out], pa.int64()),
             pa.array([round(o[2], 6) for o in out], pa.float64()), pa.array(spans, kind)],
            names=["doc_id", "n_blocks", "licenses", "n_confirmed", "n_different", "best_saving", "spans"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: candidate blocks, confirmed licenses (comma-joined) and their spans in code points."""
    hinted = F.when(F.col(text_col).rlike(HINT), F.col(text_col))
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), hinted.alias("text")), _scan_rows, _SCHEMA)


def query(spark, sf_dir):
    """Licenses named in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
