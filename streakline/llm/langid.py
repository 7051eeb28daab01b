"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document and language:

* Text: naive Bayes over hashed byte trigrams of the lower-cased text. The
  models are the trigram counts of all items by declared language (one grouped
  aggregation over the corpus; the counts are a fixed number of bins). An extra
  class ``und`` gives every bin the same chance; it wins where a text looks like
  none of the languages. The log-likelihood is tempered because trigrams of one
  text depend on each other.
* Declared markup language: P(declared | language), from all items.
* Address suffix (last label of the host): P(suffix | language), from all items.
* Host: P(language | host), counted by host, smoothed towards its registered
  domain and that towards the corpus. An item's own vote is taken out of its
  host's counts first, so it is not heard twice.

Counts take the vote of an item's text where that is clear. All tables but the
host's are of fixed size; host counts are joined by host on narrow rows (ids and
scores, no texts), so a hot host is split like any skewed join.

An item is rejected if it has no letters, if ``und`` wins or if no language
reaches ``MIN_CONFIDENCE``.

Results: one row per input row, repeated rows and null ids included. Null or
empty text: no letters, rejected, language ``und`` with confidence 0. A null or
unlisted declared language, a null host or a null suffix is no evidence. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streakline.llm import textblocks as tb
from streakline.llm.shared import Scratch, free_name, map_arrow

LANGUAGES = ("en", "de", "fr", "es")
BINS = 1 << 13
TEMPER = 0.3
MIN_CONFIDENCE = 0.5
CLEAR = 0.9
#: Votes that a level of the host hierarchy weighs against what is counted below it.
PRIOR_VOTES = 8.0
UND_PRIOR = 0.01
#: Text of a block: its trigrams take some 80 times that in a worker.
BLOCK_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[0xC3:0xF5] = True
_FOLD = tb.LOWER.copy()
_FOLD[0x00:0x30] = _FOLD[0x3A:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0x20  # what is no letter or digit
_FOLD[0x30:0x3A] = ord("0")


def _trigrams(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each trigram with a letter, its row, whether the row has letters); one space stands between rows."""
    n = len(block.data)
    padded = np.full(n + 2 * block.rows, 0x20, np.uint8)
    row = np.repeat(np.arange(block.rows), np.diff(block.offs))
    padded[np.arange(n) + 2 * row + 1] = _FOLD[block.data]
    rows = np.repeat(np.arange(block.rows), np.diff(block.offs) + 2)
    code = padded.astype(np.uint64)
    tri = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:]
    letter = _LETTER[padded]
    ok = (rows[:-2] == rows[2:]) & letter[1:-1]
    h = (tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS.bit_length() + 1)
    has = np.bincount(rows[letter], minlength=block.rows) > 0
    return h[ok].astype(np.int64), rows[1:-1][ok], has


def _count_rows(languages):
    def rows(batches):
        sums = {x: np.zeros(BINS, np.int64) for x in languages}
        for batch in batches:
            said = batch.column(1).to_pylist()
            for block in tb.blocks(batch.column(0), BLOCK_BYTES):
                h, row, _ = _trigrams(block)
                own = np.array([languages.index(x) if x in sums else -1
                                for x in said[block.lo:block.lo + block.rows]])[row]
                for i, x in enumerate(languages):
                    sums[x] += np.bincount(h[own == i], minlength=BINS)
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(v[at])], names=["lang", "bin", "n"])

    return rows


def text_models(items: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """Log-probabilities (languages + und, BINS) from the trigram counts of all items."""
    got = map_arrow(items.select("text", "declared"), _count_rows(list(languages)), "lang string, bin int, n long")
    counts = np.zeros((len(languages) + 1, BINS))
    for r in got.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():  # at most languages x BINS rows
        counts[languages.index(r["lang"]), r["bin"]] = r["n"]
    models = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    models[:-1][counts[:-1].sum(1) == 0] -= 1  # a language nobody declares is no better than und
    return models


def _score_rows(models: np.ndarray):
    def rows(batches):
        for batch in batches:
            for block in tb.blocks(batch.column(batch.num_columns - 1), BLOCK_BYTES):
                h, row, has = _trigrams(block)
                ll = np.stack([np.bincount(row, weights=m[h], minlength=block.rows) for m in models], 1)
                ll = TEMPER * (ll - ll.max(1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(block.lo, block.rows) for i in range(batch.num_columns - 1)),
                     tb.lists(ll.ravel(), np.arange(block.rows + 1) * len(models), pa.float64()), pa.array(has)],
                    names=[*batch.schema.names[:-1], "ll", "letters"])

    return rows


def _table(column: pa.Array, k: int) -> np.ndarray:
    """A column of lists of ``k`` numbers as a matrix; nulls are zeros."""
    out = np.zeros((len(column), k))
    ok = np.asarray(column.is_valid())
    out[ok] = np.asarray(column.drop_null().flatten()).reshape(-1, k)
    return out


def _fused_rows(languages, total, said, n_suffix, n_key):
    """Posterior of each row from its text scores, declared language and the counts of its host."""
    k = len(languages)
    prior = (total + 1) / (total.sum() + k)
    given = np.log((said + 1) / (said.sum(0) + len(said) + 1))  # (declared, language)

    def rows(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names[n_key:], batch.columns[n_key:], strict=True))
            n = len(batch)
            own = np.zeros((n, k))
            vote = np.asarray(col["vote"].fill_null(-1))
            own[vote >= 0, vote[vote >= 0]] = 1

            def smoothed(name, up):
                seen = np.asarray(col[name].is_valid())[:, None]
                c = np.where(seen, _table(col[name], k) - own, 0)
                return (c + PRIOR_VOTES * up) / (c.sum(1, keepdims=True) + PRIOR_VOTES)

            host = smoothed("hv", smoothed("dv", np.tile(prior, (n, 1))))
            known = np.asarray(col["sv"].is_valid())[:, None]
            suffix = np.where(known, np.log((np.where(known, _table(col["sv"], k) - own, 0) + 1) / (total + n_suffix)), 0)
            at = np.array([languages.index(x) if x in languages else -1 for x in col["declared"].to_pylist()], np.int64)
            declared = np.where(at[:, None] >= 0, given[at], 0)
            ll = _table(col["ll"], k + 1)
            other = suffix + declared
            f = np.concatenate([ll[:, :k] + np.log(host) + other,
                                (ll[:, k] + np.log(UND_PRIOR) + (other * prior).sum(1))[:, None]], 1)
            best = f.argmax(1)
            sure = 1 / np.exp(f - f.max(1, keepdims=True)).sum(1)
            letters = np.asarray(col["letters"])
            best = np.where(letters, best, k)
            names = [*languages, "und"]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_key], pa.array([names[i] for i in best], pa.string()),
                 pa.array(np.where(letters, sure.round(6), 0.0)),
                 pa.array(letters & (best < k) & (sure >= MIN_CONFIDENCE))],
                names=[*batch.schema.names[:n_key], "language", "confidence", "kept"])

    return rows


def identify(items: DataFrame, key: list[str], languages=LANGUAGES) -> DataFrame:
    """``key`` columns, language, confidence, kept of every item.

    ``items``: the key columns, text, declared (markup language), host, domain, suffix; null where unknown.
    """
    run = Scratch(items.sparkSession, "langid")
    languages = list(languages)
    k = len(languages)
    src = items.select(*key, F.lower(F.substring("declared", 1, 2)).alias("declared"), "host", "domain", "suffix", "text")
    schema = src.drop("text").schema.add("ll", T.ArrayType(T.DoubleType())).add("letters", T.BooleanType())
    scored = map_arrow(src, _score_rows(text_models(src, languages)), schema)
    part = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))  # the best one's part is exp(0)
    vote = F.array_position("ll", F.lit(0.0)).cast("int") - 1
    scored = run.keep(scored.withColumn("vote", F.when(
        F.col("letters") & (F.lit(1.0) >= CLEAR * part) & (vote < k), vote)), "scored")

    votes = F.array([F.count_if(F.col("vote") == i) for i in range(k)])
    total = np.array(scored.agg(votes.alias("v")).first()["v"], float)
    said = np.zeros((k, k))
    for r in scored.where(F.col("vote").isNotNull() & F.col("declared").isin(languages)).groupBy(
            "declared", "vote").agg(F.count(F.lit(1)).alias("n")).collect():  # languages squared
        said[languages.index(r["declared"]), r["vote"]] = r["n"]

    # host counts with those of its domain and suffix, one row a host
    hosts = run.keep(scored.where("host is not null").groupBy("host", "domain", "suffix").agg(votes.alias("hv")), "hosts")

    def level(name: str, alias: str) -> DataFrame:
        return hosts.where(F.col(name).isNotNull()).groupBy(name).agg(
            F.array([F.sum(F.col("hv")[i]) for i in range(k)]).alias(alias))

    n_suffix = hosts.select("suffix").distinct().count() + 1
    tree = run.keep(hosts.join(level("domain", "dv"), "domain", "left").join(level("suffix", "sv"), "suffix", "left")
                    .select(F.col("host").alias("h"), F.col("domain").alias("d"), F.col("suffix").alias("s"),
                            "hv", "dv", "sv"), "tree")
    at = (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("d")) & F.col("suffix").eqNullSafe(F.col("s"))
    seen = scored.join(tree, at, "left").select(*key, "declared", "ll", "letters", "vote", "hv", "dv", "sv")
    out = items.select(*key).schema.add("language", "string").add("confidence", "double").add("kept", "boolean")
    return map_arrow(seen, _fused_rows(languages, total, said, n_suffix, len(key)), out)


def page_items(pages: DataFrame) -> DataFrame:
    """Evidence of raw web pages: visible text, declared language, host and its parents."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[A-Za-z]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1))
    p = pages.select("page_id", text.alias("text"), F.nullif(F.regexp_extract(
        html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"))
    return (p.withColumn("domain", F.substring_index("host", ".", -2))
            .withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))))


def document_items(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Evidence of plain documents: their text, declared language and source."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col(lang_col).cast("string").alias("declared"),
                       F.col(source_col).cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))


def in_known_language(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they are.

    Rows that agree in id, text, language and source share one decision. Other
    columns may have any name.
    """
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "text", "lang", "source")])
    items = document_items(docs).withColumn("mark", F.xxhash64(*[
        F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "text", "declared", "host")]))
    run = Scratch(docs.sparkSession, "langid-out")
    out = run.keep(identify(items, ["mark"]).where("not kept").select("mark").distinct(), "rejected")
    m = free_name(docs, "mark")
    return docs.withColumn(m, mark).join(out.withColumnRenamed("mark", m), m, "left_anti").select(
        *[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir):
    """Language of every document and every web page; one of doc_id and page_id is null."""
    docs = document_items(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("page_id", F.lit(None).cast("long"))
    pages = page_items(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("doc_id", F.lit(None).cast("long"))
    return identify(docs.unionByName(pages), ["doc_id", "page_id"])
