"""N-gram Jaccard join by parity sketches: block signatures join, Hamming bounds prune, exact sets decide.

A document's set holds its distinct word shingles (64-bit hashes, sorted).
Sets of equal content collapse to one class first. Two classes of sizes a, b
link when ``100 * |A n B| >= 75 * |A u B|``, so their symmetric difference has
at most ``(a + b) / 7`` shingles.

* Size bands. Sizes from ``BASE`` up fall into bands that double. A set emits
  its sketch in its own band, and in the band below if a partner there is
  possible (it is less than 4/3 of its band's lower end).
* Parity sketch of a band. The hash space is cut into ``G`` ranges, one more
  than the largest symmetric difference possible in the band. A range's
  signature is the XOR of the shingle hashes in it; by pigeonhole a linked pair
  agrees in at least one range. Ranges empty in a set say nothing and emit no
  key, and of more than ``RANGES`` ranges the first ``RANGES`` form the sketch:
  a linked pair then agrees in some non-empty range of it with a failure
  probability below 1e-9 over the hash (about a third of all ranges agree at
  the threshold itself, far more above it).
* Sets below ``4/3 * BASE`` emit the XOR of every three neighbours in cyclic
  hash order instead. A linked pair shares such a triple always: at most a
  quarter of the union differs, so some arc between two differing shingles
  holds three common ones.
* Join. Signatures that only one class has are dropped, and of those with the
  same members one stays. Members are verified
  against two hubs first, the outermost ones of all their signatures, and linked
  into components, then, in a few rounds, against up to ``HUBS`` members of the
  largest component that their signatures hold. So a class costs a few checks,
  however many signatures it shares, and a large group of near copies never all
  of its pairs. Only signatures whose members still lie in different components
  are joined in pairs, across components, and of those only pairs pass whose
  bit sketches (one parity bit a bucket) lie within the bound: their Hamming
  distance never exceeds the symmetric difference. Differing shingles that
  share a bucket cancel, so the pairs are held against a wide sketch (at least
  ``WIDE`` bits) after the narrow one; in it few do.
* Verification intersects the exact shingle sets.

Results: one row per input row. Null or empty text, or text without words: no
shingles, linked with nothing. Fewer words than ``k``: the whole sequence is
the one shingle. Rows without id keep a null id; they link and count like any
other, and a component without any id has a null ``component_id``. Repeated
ids are rows of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.components import components
from streakline.llm.shared import Scratch, free_name, map_arrow

BASE = 96
RANGES = 64
WIDE = 2048
HUB_ROUNDS = 3
HUBS = 8  # members of the largest component that a class meets in a round
BLOCK = tb.BLOCK_BYTES // 4  # bytes of texts worked on at a time
BROADCAST_ROWS = 1 << 21  # rows of two numbers that may go to every executor: 32 MB
_SKETCH_SCHEMA = ("doc_id long, mark long, n_shingles long, cls long, main boolean, band int, "
                  "keys array<long>, bits array<long>")
_U = np.uint64


def shingle_sets(block: tb.Block, k: int, sep: np.ndarray):
    """Yield the sorted distinct shingle hashes of every row of the block."""
    low = block.lowered()
    starts, ends, woffs = low.words(sep)
    words = low.span_hash(low.prefix(), starts, ends)
    grams = tb.window_hash(words, k)
    for r in range(low.rows):
        a, b = int(woffs[r]), int(woffs[r + 1])
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield tb.window_hash(words[a:b], b - a)
        else:
            yield np.zeros(0, _U)


def band_ranges(band: int) -> int:
    """Hash ranges of a band: more than (a + b) / 7 for every pair that meets in it."""
    return BASE * 2 ** (band + 1) // 3 + 1


def _bits(u: np.ndarray, size: int, least: int = 256) -> np.ndarray:
    m = max(least, 1 << (size - 1).bit_length())
    pos = (tb.mix(u ^ _U(0x5DEECE66D)) >> _U(64 - (m.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(pos, minlength=m) & 1).astype(np.uint8)).view(np.int64)


def set_bands(n: int) -> list[tuple[int, int]]:
    """(band, largest size to meet there) of a set of ``n``: its own band, and those of possible smaller partners."""
    out = [(-1, 512)] if 3 <= n < BASE * 4 // 3 else []
    if n >= BASE:
        band = (n // BASE).bit_length() - 1
        lower = [band - 1] if band and 3 * n < 4 * BASE * 2 ** band else []
        out += [(b, BASE * 2 ** (b + 1)) for b in [band, *lower]]
    return out


def sketch(u: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(band, keys, bits) of a set; band -1 is the one of triples."""
    n, out = len(u), []
    xor = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(u)])
    for b, size in set_bands(n):
        if b < 0:
            e = np.concatenate([u, u[:2]])
            keys = np.unique(tb.mix(e[:n] ^ e[1:n + 1] ^ e[2:n + 2]))
        else:
            g = band_ranges(b)
            cuts = np.array([-(-(i << 64) // g) for i in range(min(g, RANGES) + 1)][:-1], dtype=_U)
            at = np.searchsorted(u, cuts)
            end = np.searchsorted(u, _U(-(-(RANGES << 64) // g))) if g > RANGES else n
            at = np.append(at, end)
            sig = xor[at[1:]] ^ xor[at[:-1]]
            full = np.flatnonzero(at[1:] > at[:-1])
            keys = tb.mix(sig[full] + (full.astype(_U) * _U(64) + _U(b + 1)) * _U(0xD6E8FEB86659FD93))
        out.append((b, keys, _bits(u, size)))
    return out


def _class_of(u: np.ndarray) -> int:
    if not len(u):
        return 0
    a, b = int(tb.mix(u ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)), int(np.bitwise_xor.reduce(tb.mix(u)))
    return int(tb.mix(np.array([a ^ (b * 0x9E3779B97F4A7C15 + len(u)) & (2 ** 64 - 1)], dtype=_U)).view(np.int64)[0])


def _sketch_rows(k: int):
    sep = tb.separators("space")

    def rows(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for block in tb.blocks(batch.column(1), BLOCK):
                row, n, cls, main, band, keys, bits = [], [], [], [], [], [], []
                for i, u in enumerate(shingle_sets(block, k, sep)):
                    c = _class_of(u)
                    for j, (b, ks, bs) in enumerate(sketch(u) or [(-2, np.zeros(0, _U), np.zeros(0, np.int64))]):
                        row.append(block.lo + i), n.append(len(u)), cls.append(c), main.append(j == 0)
                        band.append(b), keys.append(ks.view(np.int64)), bits.append(bs)
                off = lambda parts: np.cumsum([0, *map(len, parts)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), marks.take(pa.array(row)), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(main),
                     pa.array(band, pa.int32()), tb.lists(np.concatenate(keys), off(keys), pa.int64()),
                     tb.lists(np.concatenate(bits), off(bits), pa.int64())],
                    names=["doc_id", "mark", "n_shingles", "cls", "main", "band", "keys", "bits"])

    return rows


def _set_rows(k: int):
    sep = tb.separators("space")

    def rows(batches):
        for batch in batches:
            for block in tb.blocks(batch.column(0), BLOCK):
                sets = list(shingle_sets(block, k, sep))
                off = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class_of(u) for u in sets], pa.int64()),
                     tb.lists(np.concatenate(sets).view(np.int64), off, pa.int64())], names=["cls", "grams"])

    return rows


def _wide_rows(batches):
    for batch in batches:
        cls, band, bits = [], [], []
        for c, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
            u = grams.values.to_numpy().view(_U)
            for b, size in set_bands(len(u)):
                cls.append(c), band.append(b), bits.append(_bits(u, size, WIDE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls, pa.int64()), pa.array(band, pa.int32()),
             tb.lists(np.concatenate([np.zeros(0, np.int64), *bits]), np.cumsum([0, *map(len, bits)]), pa.int64())],
            names=["cls", "band", "wide"])


def _may_link(a: str, b: str, percent: int, *sketches: str):
    """Condition on two (n, sketches): sizes and the Hamming distances of the sketches allow the threshold."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    may = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    for x in sketches:
        apart = F.aggregate(F.zip_with(f"{a}.{x}", f"{b}.{x}", lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                            F.lit(0), lambda s, v: s + v)
        may = may & (apart * (100 + percent) <= (100 - percent) * (n + m))
    return may


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs, those whose exact sets reach the threshold."""
    inter = F.size(F.array_intersect("ga", "gb"))
    return (pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
            .where(100 * inter >= percent * (F.size("ga") + F.size("gb") - inter)).select("a", "b"))


def _stars(labels: DataFrame) -> DataFrame:
    """An edge from each node to its label: the same components from no more edges than nodes."""
    return labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))


def _with_sizes(m: DataFrame, labels: DataFrame) -> DataFrame:
    """``m`` with the size of each row's component.

    Components of more than a thousandth of all classes are at most a thousand:
    their sizes are broadcast, so no key of the shuffled join is a large one.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    j = m.join(F.broadcast(sizes.where(F.col("size") > labels.count() // 1000)), "label", "left")
    rest = j.where("size is null").drop("size").join(sizes, "label", "left").withColumn(
        "size", F.coalesce("size", F.lit(1)))
    return j.where("size is not null").unionByName(rest)


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, Scratch]:
    """Rows (doc_id, mark, n_shingles, cls, label) of all documents; mark: a hash of the text; label: the component."""
    if percent < 75:
        raise ValueError("the sketches guarantee links from 75 percent on")
    spark = docs.sparkSession
    run = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = run.keep(map_arrow(docs.withColumn("mark", F.xxhash64("text")), _sketch_rows(k), _SKETCH_SCHEMA), "sketches")
    rows = run.keep(sk.where("main").select("doc_id", "mark", "n_shingles", "cls"), "rows")
    heads = rows.groupBy("cls").agg(F.min("doc_id").alias("head"))
    # one row a class and band: copies collapse here, before any key is made
    bands = (sk.where("band >= -1").groupBy("cls", "band")
             .agg(F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n")))
    bands = run.keep(bands, "classes")
    run.drop("sketches")
    keys = bands.select("cls", "band", F.explode("keys").alias("key"))
    # signatures with the same members say the same: one of them stays
    shared = (keys.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("far"),
                                      F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls", "band")).alias("x"),
                                      F.bit_xor(F.xxhash64("band", "cls")).alias("y"))
              .where("hub <> far").groupBy("hub", "far", "n", "x", "y").agg(F.min("key").alias("key"))
              .select("key", "hub", "far"))
    members = run.keep(keys.join(shared, "key"), "members")

    # exact sets of the classes that share a signature, from one document of each
    wanted = members.select("cls").distinct().join(heads, "cls").select(F.col("head").alias("doc_id")).distinct()
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    sets = run.keep(map_arrow(texts, _set_rows(k), "cls long, grams array<long>").dropDuplicates(["cls"]), "sets")
    marks = run.keep(bands.select("cls", "band", "n", "bits").join(
        members.select("cls", "band").distinct(), ["cls", "band"], "left_semi"), "marks")
    run.drop("classes")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of (a, b, band), the ordered distinct pairs whose sizes and parity bits allow the threshold."""
        p = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                                         "band").distinct()
        side = lambda c: marks.select(F.col("cls").alias(c), "band", F.struct("n", "bits").alias(f"m{c}"))
        p = p.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
        return p.where(_may_link("ma", "mb", percent, "bits")).select("a", "b").distinct()

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of signatures that still join different components, with their labels."""
        m = (members.select("key", "cls", "band").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
             .select("key", "cls", "band", F.coalesce("label", "cls").alias("label")))
        two = m.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        return m.join(two.select("key"), "key", "left_semi")

    # every class against two hubs, whatever the number of its signatures
    ends = members.groupBy("cls", "band").agg(F.min("hub").alias("hub"), F.max("far").alias("far"))
    first = ends.select(F.col("hub").alias("a"), F.col("cls").alias("b"), "band").union(
        ends.select(F.col("far").alias("a"), F.col("cls").alias("b"), "band"))
    tested = run.keep(possible(first), "tested0")
    links = run.keep(_verified(tested, sets, percent), "links0")
    labels = components(links, run, "comp0")
    # then against members of the largest component in its signatures, others in each round
    for r in range(1, HUB_ROUNDS + 1):
        m = run.keep(mixed(labels), f"mixed{r}")
        names = [f"hub{j}" for j in range(HUBS)]
        hubs = _with_sizes(m, labels).groupBy("key").agg(*[F.max(F.struct(
            "size", "label", F.xxhash64("cls", "key", F.lit(r), F.lit(j)).alias("h"), "cls")).alias(x)
            for j, x in enumerate(names)])
        pairs = (m.join(hubs, "key").where(F.col("label") != F.col("hub0.label"))
                 .groupBy("cls", "band").agg(*[F.max(x).alias(x) for x in names])
                 .select(F.explode(F.array_distinct(F.array(*[f"{x}.cls" for x in names]))).alias("a"),
                         F.col("cls").alias("b"), "band"))
        new = run.keep(possible(pairs).join(tested, ["a", "b"], "left_anti"), f"tested{r}")
        tested = tested.union(new)
        found = run.keep(_verified(new, sets, percent), f"links{r}")
        run.drop(f"mixed{r}")
        if found.isEmpty():
            break
        links = _stars(labels).union(found)
        labels = components(links, run, f"comp{r}")
    # what is left: pairs across components, pruned by the parity bits before they leave the join
    wide = map_arrow(sets, _wide_rows, "cls long, band int, wide array<long>")
    left = run.keep(mixed(labels).join(marks, ["cls", "band"]).join(wide, ["cls", "band"]).select(
        "key", "cls", "label", F.struct("n", "bits", "wide").alias("m")), "left")
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls"))
                  & (F.col("x.label") != F.col("y.label")) & _may_link("x.m", "y.m", percent, "bits", "wide"))
    rest = rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    links = run.keep(_stars(labels).union(_verified(rest.join(tested, ["a", "b"], "left_anti"), sets, percent)), "links")
    labels = components(links, run, "comp")

    for name in ("members", "left", "sets", "marks"):  # all that reads them is written
        run.drop(name)
    out = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "label", F.coalesce("label", "cls"))
    return out.select("doc_id", "mark", "n_shingles", "cls", "label"), run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id) of all documents; see the module text.

    ``percent`` is the similarity threshold; the sketches are built for 75 and
    also serve every higher one.
    """
    out, _ = _labelled(docs, id_col, text_col, k, percent)
    smallest = out.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("low"))
    return (out.join(smallest, "label", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
                    F.col("cls").alias("class_id")))


def near_duplicates_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                        percent: int = 75) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id (null ids last).

    Decisions are made by row, that is by id and text: of several texts under one
    id each is judged with its own group. Of texts of a group under the same
    smallest id the one with the least hash stays, and of equal rows one. Rows
    without words all stay. All columns pass through.
    """
    rows, run = _labelled(docs, id_col, text_col, k, percent)
    rows = run.keep(rows, "labelled")
    worded = rows.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = worded.groupBy("label").agg(F.min(order).alias("best"))
    of = worded.groupBy("doc_id", "mark", "label").agg(F.count(F.lit(1)).alias("n")).join(best, "label")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    judged = run.keep(of.select("doc_id", "mark", first.alias("first"), "n").where("not first or n > 1"), "judged")
    i, t = free_name(docs, "id"), free_name(docs, "mark")
    keyed = docs.withColumn(t, F.xxhash64(F.col(text_col).cast("string"))).withColumn(i, F.col(id_col).cast("long"))
    # a row or more of a pair of numbers: to every executor up to a size, else both sides move
    judged = judged.select(F.col("doc_id").alias("jid"), F.col("mark").alias("jmark"), "first")
    small = (lambda df: F.broadcast(df)) if judged.count() <= BROADCAST_ROWS else (lambda df: df)

    def on(side: DataFrame):
        return keyed[i].eqNullSafe(side["jid"]) & (keyed[t] == side["jmark"])

    several = judged.where("first")
    stay = keyed.join(small(judged), on(judged), "left_anti").drop(i, t)
    # of equal rows one: few rows, unless a text without id is repeated very often
    picked = keyed.join(small(several), on(several), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    one = picked.groupBy(i, t).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.to_json(F.struct(*others))).alias("r")).select("r.*")
    return stay.unionByName(one)


def query(spark, sf_dir):
    """Components of the documents linked at a shingle similarity of 0.75 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5
    THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
cls AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g) GROUP BY s),
t AS (SELECT c, n, unnest(s) AS sh FROM cls),
common AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM t a JOIN t b ON a.sh = b.sh AND a.c < b.c AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT c AS src, c AS dst FROM cls WHERE n > 0 UNION SELECT r.src, u.b FROM r JOIN u ON r.dst = u.a),
comp AS (SELECT src, min(dst) AS low FROM r GROUP BY src)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE comp.low END AS component_id
FROM g LEFT JOIN cls ON cls.s = list_sort(g.s) LEFT JOIN comp ON comp.src = cls.c
"""
