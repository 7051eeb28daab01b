"""Cross-site boilerplate removal: lines that many sites carry, by HyperLogLog spread.

1. Every line with a word becomes a 64-bit hash (ASCII letters lower-cased,
   outer white space dropped) with its site and place.
2. Lines meet per site first, combined before the shuffle. A line seen under one
   site only cannot spread; of the others the sites go into HyperLogLog
   sketches, merged by aggregation.
3. Estimates within ``MARGIN`` of ``min_sites`` (six standard errors) are
   replaced by exact distinct counts.
4. Lines of at least ``min_sites`` sites are boilerplate: every occurrence goes
   but the first (smallest document id, then text hash, then place), so no
   content is lost to the corpus.

Removal needs no shuffle of texts while the boilerplate lines fit a checked
bound (``BROADCAST_LINES``): they go to the tasks as sorted arrays. Beyond it
the places to cut are joined to the documents.

Results: one row per input row. Null text stays null, with 0 lines. Rows
without id come after all ids; repeats of one row (same id and text) get the
same result. A null site counts as one site of its own. Lines without a word
stay. An empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streakline.llm import textblocks as tb
from streakline.llm.shared import Scratch, free_name, map_arrow

MIN_SITES = 10
MARGIN = 0.1
LOG_K = 12
BROADCAST_LINES = 2_000_000
_NO_ID = 2 ** 63 - 1
_WORD = tb.separators("space")


def line_hashes(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: (hash, row, place in the row); and all lines: (start, end with the line feed)."""
    low = block.lowered()
    nl = np.flatnonzero(low.data == 10)
    a = np.sort(np.concatenate([low.offs[:-1], nl + 1]))
    b = np.sort(np.concatenate([nl, low.offs[1:]]))
    per = np.bincount(np.searchsorted(low.offs, nl, "right") - 1, minlength=low.rows)[:low.rows] + 1
    row = np.repeat(np.arange(low.rows), per)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    starts, ends, _ = low.words(_WORD)
    i, j = np.searchsorted(starts, a), np.searchsorted(ends, b, "right")
    said = j > i  # words never cross a line feed
    i, j = i[said], j[said]
    h = low.span_hash(low.prefix(), starts[i], ends[j - 1]).view(np.int64) if len(i) else np.zeros(0, np.int64)
    return h, row[said], pos[said], row, pos


def _line_rows(batches):
    for batch in batches:
        doc, t, site = (np.asarray(batch.column(i)) for i in range(3))
        for block in tb.blocks(batch.column(3)):
            h, row, pos, _, _ = line_hashes(block)
            row = row + block.lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(site[row]), pa.array(doc[row]), pa.array(t[row]), pa.array(pos.astype(np.int32))],
                names=["line", "site", "doc", "t", "pos"])


def boilerplate(lines: DataFrame, run: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, doc, t, pos): each line of at least ``min_sites`` sites with its first place.

    Lines meet per site first, combined before the shuffle: a line holds one row a
    site from there on, however often it occurs.
    """
    pairs = run.keep(lines.groupBy("line", "site").agg(F.min(F.struct("doc", "t", "pos")).alias("f")), "pairs")
    wide = run.keep(pairs.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where(
        "a <> b" if min_sites > 1 else "true").select("line"), "wide")
    some = run.keep(pairs.join(wide, "line", "left_semi"), "some")
    est = some.groupBy("line").agg(F.hll_sketch_agg("site", LOG_K).alias("s")).select(
        "line", F.hll_sketch_estimate("s").alias("n"))
    est = run.keep(est.where(F.col("n") >= min_sites * (1 - MARGIN)), "estimates")
    sure = est.where(F.col("n") > min_sites * (1 + MARGIN)).select("line")
    near = some.join(est.where(F.col("n") <= min_sites * (1 + MARGIN)).select("line"), "line", "left_semi")
    exact = near.groupBy("line").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites).select("line")
    first = (some.join(sure.unionByName(exact), "line", "left_semi").groupBy("line").agg(F.min("f").alias("f")))
    return run.keep(first.select("line", "f.*"), "boilerplate")


def _without(text: str | None, gone: np.ndarray) -> str | None:
    if text is None or not len(gone):
        return text
    drop = set(gone.tolist())
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def _cut_batch(batch, at: int, texts: list, n_lines, n_gone, names):
    cols = [batch.column(i) for i in range(batch.num_columns - 2)]
    cols[at] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())],
                                      names=names)


def _cut_by_list(shared, at: int, names):
    """Rows with (.., id, text hash) lose the shared lines."""
    def rows(batches):
        line, first = shared.value
        for batch in batches:
            col = batch.column(at).to_pylist()
            doc, t = (np.asarray(batch.column(batch.num_columns - j)) for j in (2, 1))
            texts, total, n_gone = list(col), np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
            for block in tb.blocks(batch.column(at)):
                h, row, pos, every, _ = line_hashes(block)
                total[block.lo:block.lo + block.rows] = np.bincount(every, minlength=block.rows)
                if not len(line) or not len(h):
                    continue
                i = np.minimum(np.searchsorted(line, h), len(line) - 1)
                own = row + block.lo
                f = first[i]
                hit = (line[i] == h) & ~((f[:, 0] == doc[own]) & (f[:, 1] == t[own]) & (f[:, 2] == pos))
                own, pos = own[hit], pos[hit]
                for r in np.unique(own):
                    gone = pos[own == r] if len(own) < 64 else pos[np.searchsorted(own, r):np.searchsorted(own, r, "right")]
                    texts[r], n_gone[r] = _without(col[r], gone), len(gone)
            total[[i for i, x in enumerate(col) if x is None]] = 0
            yield _cut_batch(batch, at, texts, total, n_gone, names)

    return rows


def _cut_by_join(at: int, names):
    """Rows with (.., places, 0) lose the lines at these places."""
    def rows(batches):
        for batch in batches:
            col = batch.column(at).to_pylist()
            cut = [np.unique(np.array(x or [], np.int64)) for x in batch.column(batch.num_columns - 2).to_pylist()]
            yield _cut_batch(batch, at, [_without(x, c) for x, c in zip(col, cut, strict=True)],
                             [0 if x is None else x.count("\n") + 1 for x in col], [len(c) for c in cut], names)

    return rows


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All columns of ``docs`` with boilerplate cut out of the text, and __lines, __gone (lines before, lines cut).

    These two are always the last columns; where ``docs`` has such a column, the
    added one takes more underscores.
    """
    spark = docs.sparkSession
    run = Scratch(spark, "lines")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    t = F.coalesce(F.xxhash64(text_col), F.lit(0).cast("long"))
    src = docs.select(doc.alias("doc"), t.alias("t"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))),
                      F.col(text_col).alias("text"))
    lines = run.keep(map_arrow(src, _line_rows, "line long, site long, doc long, t long, pos int"), "lines")
    first = boilerplate(lines, run, min_sites)
    at = docs.columns.index(text_col)
    free = lambda x: free_name(docs, x)
    schema = T.StructType([*docs.schema, *[T.StructField(free(x), T.LongType()) for x in ("__lines", "__gone")]])
    names = schema.names
    numbered = [f"c{i}" for i in range(len(names))]  # columns reach Python by number: their names may hold dots
    if first.count() <= broadcast_lines:
        got = first.orderBy("line").toArrow()  # at most broadcast_lines rows of 28 bytes
        line = np.asarray(got.column("line").combine_chunks()).astype(np.int64)
        place = np.stack([np.asarray(got.column(c).combine_chunks()).astype(np.int64) for c in ("doc", "t", "pos")], 1)
        shared = spark.sparkContext.broadcast((line, place))
        keyed = docs.select("*", doc.alias(free("__doc")), t.alias(free("__t"))).toDF(*numbered)
        return map_arrow(keyed, _cut_by_list(shared, at, names), schema)
    hits = lines.join(first.select("line", F.struct("doc", "t", "pos").alias("f")), "line")
    cut = (hits.where(F.struct("doc", "t", "pos") != F.col("f"))
           .groupBy(F.col("doc").alias(free("__cd")), F.col("t").alias(free("__ct")))
           .agg(F.collect_set("pos").alias(free("__cut"))))
    joined = docs.join(cut, (doc == cut[free("__cd")]) & (t == cut[free("__ct")]), "left")
    joined = joined.select(*[f"`{c}`" for c in docs.columns], free("__cut"), F.lit(0).alias(free("__none")))
    return map_arrow(joined.toDF(*numbered), _cut_by_join(at, names), schema)


def query(spark, sf_dir):
    """Every document without the lines that ten or more sources carry."""
    out = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines, gone = out.columns[-2:]
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(gone).alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
b AS (SELECT key, min((doc_id, pos)) AS f FROM k WHERE key <> '' GROUP BY key
      HAVING count(DISTINCT coalesce(source, chr(1))) >= 10),
m AS (SELECT k.doc_id, k.pos, k.ln, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.f AS gone
      FROM k LEFT JOIN b ON b.key = k.key),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             string_agg(ln, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""
