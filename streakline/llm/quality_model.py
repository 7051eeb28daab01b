"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words. A text is cut into runs of letters, digits or other visible characters
(any byte above 0x7F counts as a letter). Letters A-Z are lower-cased. Three
mark words stand for form: ``<LINE>`` for a line feed, ``<CAPS>`` after a run of
two capitals or more, ``<AGAIN>`` after a word that repeats the one before it.
Words fall into ``BUCKETS`` buckets by a fixed hash, so the tables below have a
fixed size however many words a corpus has; rare words share buckets.

Random indexing. Each bucket has a sparse random index vector of ``DIM`` places
with ``ONES`` of +1 or -1, made from its number. The vector of a word is the sum
of the index vectors of the words up to ``WINDOW`` places before and after it,
over all documents, labelled or not. Tasks add up dense chunks of the table and
write each once; chunks are summed by chunk number. The vectors are then scaled
to length 1 with the mean direction taken out; this table has ``BUCKETS * DIM``
numbers (4 MB) and goes to the tasks as a broadcast of that proven size.

Pooling. A document is the mean and the spread (standard deviation) of its
words' vectors, the mean of their index vectors, and the logarithm of its number
of words.

Network. ``tanh`` hidden layer and one logistic output, trained in numpy with
Adam on at most ``MAX_TRAIN`` labelled documents (the ones of least hash, so the
choice is by chance and repeatable). Four fifths fit the weights; the other
fifth stops the training and sets the temperature that divides the output's
logit, by least log loss. Labels weigh alike by class while fitting, and the
class balance is put back into the logit before the temperature is set.

Results: one row per input row, repeated rows and null ids included. Null and
empty texts have no words: their pooled vector is zero, and they are scored like
any other. Labels that are null, or of ids without a document, are not used; of
an id with several labels or texts all pairs are used. Without labels of both
classes the score is the share of label 1 (0.5 without any). An empty table
gives an empty result. Other columns are ignored. Texts are read whole, a block
of about 1 MB at a time; a text longer than that is a block of its own and needs
some 30 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.llm import textblocks as tb
from streakline.llm.shared import map_arrow

BUCKETS = 1 << 14
DIM = 64
ONES = 4
WINDOW = 2
CHUNK = 1 << 8          # buckets of one row of the table
SLICE = 1 << 11         # words pooled at a time
SPAN = 1 << 17          # words whose neighbours are counted at a time
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 200
BATCH = 256
PATIENCE = 20
FOLDS = 3
HELD_OUT = 1
U = np.uint64

# Byte classes: 0 space, 1 letter, 2 digit, 3 other visible.
_CLASS = np.full(256, 3, np.int8)
_CLASS[[0x20, *range(0x00, 0x20), 0x7F]] = 0
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[0x80:] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[ord("A"):ord("Z") + 1] = 1
_CAPS, _LINE, _AGAIN = BUCKETS - 1, BUCKETS - 2, BUCKETS - 3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector, (BUCKETS, ONES) each; places of one vector may meet."""
    r = tb.mix(np.arange(1, BUCKETS * ONES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return ((r % U(DIM)).astype(np.int64).reshape(-1, ONES),
            (1.0 - 2.0 * ((r >> U(40)) & U(1)).astype(np.float64)).reshape(-1, ONES))


def buckets(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block as buckets, and the word offsets of its rows."""
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64)
    kind = _CLASS[block.data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    cut = block.offs[(block.offs > 0) & (block.offs < n)]
    new[cut] = True
    line = block.data == 0x0A
    new |= line
    new[1:] |= line[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    is_line = line[starts]
    keep = (kind[starts] > 0) | is_line
    starts, ends, is_line = starts[keep], ends[keep], is_line[keep]
    word = np.empty(len(starts), np.int64)
    lo = 0
    while lo < len(starts):  # hashes of words of about 1 MB at a time, so that a long text needs no more
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + tb.BLOCK_BYTES)))
        at = starts[lo]
        part = tb.Block(block.data[at:ends[hi - 1]], np.array([0, ends[hi - 1] - at]), 0).lowered()
        word[lo:hi] = part.span_hash(part.prefix(), starts[lo:hi] - at, ends[lo:hi] - at) % U(BUCKETS - 3)
        lo = hi
    word[is_line] = _LINE
    caps = np.add.reduceat(_UPPER[block.data], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    loud = (caps >= 2) & (caps == ends - starts)
    first = np.searchsorted(starts, block.offs)
    again = np.zeros(len(starts) + 1, bool)
    again[1:-1] = word[1:] == word[:-1]
    again[first] = False  # of another row
    again = again[:-1]
    # a word is followed by its marks
    times = 1 + loud.astype(np.int64) + again
    place = np.cumsum(times) - times
    out = np.full(int(times.sum()), _CAPS, np.int64)
    out[place] = word
    out[place[again] + 1] = _AGAIN
    return out, np.append(place, len(out))[first]


def context_sums(words: np.ndarray, offs: np.ndarray, table: np.ndarray, index) -> None:
    """Add to ``table`` (BUCKETS * DIM, flat) the index vectors of each word's neighbours."""
    places, signs = index
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for lo in range(0, len(words), SPAN):
        keys, values = [], []
        for d in range(1, WINDOW + 1):
            a, b = words[lo:lo + SPAN], words[lo + d:lo + d + SPAN]
            near = row[lo:lo + len(b)] == row[lo + d:lo + d + len(b)]
            a, b = a[:len(b)][near], b[near]
            for x, y in ((a, b), (b, a)):
                keys.append((x[:, None] * DIM + places[y]).ravel())
                values.append(signs[y].ravel())
        table += np.bincount(np.concatenate(keys), weights=np.concatenate(values), minlength=BUCKETS * DIM)


def _table_rows(batches) -> Iterator[pa.RecordBatch]:
    index, table, any_ = index_vectors(), np.zeros(BUCKETS * DIM), False
    for batch in batches:
        for block in tb.blocks(batch.column(0)):
            words, offs = buckets(block)
            context_sums(words, offs, table, index)
            any_ = any_ or len(words) > 0
    if any_:
        yield _chunks(np.arange(BUCKETS // CHUNK), table.reshape(-1, CHUNK * DIM))


def _chunks(ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    # sums of signs are whole numbers: exact in any order
    flat = sums.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), tb.lists(flat.reshape(-1), np.arange(len(ids) + 1) * CHUNK * DIM, pa.int64())],
        ["chunk", "sums"])


def _summed(batches) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}  # at most BUCKETS / CHUNK chunks
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy().reshape(-1, CHUNK * DIM)
        for i, chunk in enumerate(batch.column(0).to_pylist()):
            held[chunk] = held[chunk] + flat[i] if chunk in held else flat[i]
    if held:
        ids = np.array(sorted(held))
        yield _chunks(ids, np.stack([held[i] for i in ids]))


_TABLE = "chunk long, sums array<long>"


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) vectors of all words of all texts, of length 1 or 0."""
    parts = map_arrow(docs.select(F.col("text").cast("string")), _table_rows, _TABLE)
    rows = map_arrow(parts.repartition("chunk"), _summed, _TABLE)
    table = np.zeros((BUCKETS // CHUNK, CHUNK * DIM))
    for r in rows.toLocalIterator():  # BUCKETS / CHUNK rows of fixed length
        table[r.chunk] += r.sums
    return unit_vectors(table.reshape(BUCKETS, DIM))


def unit_vectors(table: np.ndarray) -> np.ndarray:
    v = np.sign(table) * np.log1p(np.abs(table))  # frequent neighbours count, but less than in proportion
    seen = np.abs(table).sum(1) > 0
    if seen.any():
        v[seen] -= v[seen].mean(0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=(norm > 0) & seen[:, None]).astype(np.float32)


def index_table() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for j in range(ONES):
        np.add.at(out, (np.arange(BUCKETS), places[:, j]), signs[:, j])
    return out / np.sqrt(ONES, dtype=np.float32)


FEATURES = 3 * DIM + 1


def pooled(words: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Features of each row: mean and spread of word vectors, mean of index vectors, log of the number of words."""
    sums = np.zeros((len(offs) - 1, FEATURES))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for lo in range(0, len(words), SLICE):
        of = row[lo:lo + SLICE]
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sums[of[at], :-1] += np.add.reduceat(table[words[lo:lo + SLICE]], at, axis=0)
    n = np.diff(offs)[:, None]
    out = sums / np.maximum(n, 1)
    out[:, DIM:2 * DIM] = np.sqrt(np.maximum(out[:, DIM:2 * DIM] - out[:, :DIM] ** 2, 0))
    out[:, -1] = np.log1p(n[:, 0]) / 10
    return out


def pooling_table(vectors: np.ndarray) -> np.ndarray:
    """What a word adds to its document: its vector, the squares, and its index vector."""
    return np.concatenate([vectors, vectors * vectors, index_table()], axis=1).astype(np.float32)


def features(batch: pa.Array, table: np.ndarray) -> Iterator[tuple[tb.Block, np.ndarray]]:
    for block in tb.blocks(batch):
        words, offs = buckets(block)
        yield block, pooled(words, offs, table)


class Network:
    """Two layers: ``logit = w2 . tanh(x w1 + b1) + b2``, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 1 and 0 < self.share < 1
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        held = order[:max(1, len(y) // 5)]
        fit = order[max(1, len(y) // 5):]
        if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
            fit = held = order  # too few labels to hold some back
        weight = np.where(y == 1, 0.5 / self.share, 0.5 / (1 - self.share))
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        best, wait, t = (np.inf, [p.copy() for p in w]), 0, 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
                t += 1
                for p, g, a, b in zip(w, self._gradient(w, x[part], y[part], weight[part]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= 3e-3 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
            loss = _log_loss(self._logit(w, x[held]), y[held], weight[held])
            best, wait = ((loss, [p.copy() for p in w]), 0) if loss < best[0] - 1e-5 else (best, wait + 1)
            if wait >= PATIENCE:
                break
        self.w = best[1]
        # classes weighed alike so far: put their balance back, then calibrate
        self.prior = np.log(self.share / (1 - self.share))
        z = self._logit(self.w, x[held]) + self.prior
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        self.temperature = float(min(heats, key=lambda h: _log_loss(z / h, y[held], np.ones(len(held)))))

    @staticmethod
    def _logit(w, x):
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    @staticmethod
    def _gradient(w, x, y, weight, decay=1e-3):
        h = np.tanh(x @ w[0] + w[1])
        d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y) * weight / len(y)
        back = np.outer(d, w[2]) * (1 - h * h)
        return x.T @ back + decay * w[0], back.sum(0), h.T @ d + decay * w[2], np.array([d.sum()])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = (self._logit(self.w, (x - self.mean) / self.scale) + self.prior) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _log_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


def fold(doc_id: Column) -> Column:
    """Remainder that holds documents out."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def training_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(text, quality) of at most ``most`` labelled documents that are not held out, those of least hash."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id") != HELD_OUT)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    # at most `most` pairs of numbers: texts stay where they are
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MAX_TRAIN) -> Network:
    """The network of the labelled documents; only their features (``FEATURES`` numbers each) reach the driver."""
    def rows(batches):
        table = pooling_table(vectors)
        for batch in batches:
            for block, x in features(batch.column(0), table):
                yield pa.RecordBatch.from_arrays(
                    [tb.lists(x.reshape(-1), np.arange(block.rows + 1) * FEATURES, pa.float64()),
                     batch.column(1).slice(block.lo, block.rows)], ["x", "y"])

    got = map_arrow(training_texts(docs, labels, most), rows, "x array<double>, y int").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T[::16]))  # the same order in every run
    return Network(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    net = fit(docs, labels, vectors)
    model = spark.sparkContext.broadcast((vectors, net))

    def rows(batches):
        vectors, net = model.value
        table = pooling_table(vectors)
        for batch in batches:
            for block, x in features(batch.column(1), table):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.rows), pa.array(net.score(x))], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows,
                       "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    """Quality scores of all documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_scores(read("documents"), read("labels"))
