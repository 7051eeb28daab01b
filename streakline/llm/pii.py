"""Personal data by candidate gradient boosting, on DataFrame and SQL functions only.

1. Base spans. Emails, IPv4 addresses, payment cards and phone numbers by their
   patterns, leftmost and non-overlapping per kind; matches that fail their
   check (parts, Luhn, number of digits) are dropped. Base spans are always
   redacted. Patterns are guarded and possessive where that changes no match,
   so long runs of digits or letters cost linear time.
2. Candidates. Wider patterns per kind, and one for secrets (keys, tokens),
   propose spans with format features (lengths, kinds of characters) and
   context features (words in the text just before). Spans may overlap. Those
   that fail their kind's check (parts, Luhn, number of digits) are dropped.
   Secrets to which the text before assigns a credential are taken as they are.
3. Boosted trees (Spark ML) learn which of the others to take. Positive: base
   spans rewritten into the wider formats (``jane [at] example [dot] com``, 13
   to 15 digits, no country code), and assigned secrets. Negative: candidates on
   a base span of another kind or on an assigned secret, phone numbers that are
   dates or lie within a word, and unassigned secrets. Checks and assignments
   are no features, nor are a secret's words of credentials and quotes. Fixed
   ``SEEDS`` stand beside the labels of the data. The trees are fitted on about
   ``MAX_TRAIN`` labels at most, drawn by hash for each kind and label.
4. Thresholds come from the labels of all texts, grouped by score: for each
   kind the lowest score from which precision is ``PRECISION`` or more. As
   unassigned secrets may be secrets, theirs is held against the share of the
   assigned among look-alikes (Elkan and Noto).
5. Every candidate of every text is scored by the trees, written as one SQL
   expression, and joins the redacted spans if it reaches its kind's threshold
   and overlaps no base span and no assigned secret.

The first pass over the texts writes ids, base spans, candidates and lessons;
the trees and the result read that narrow table. There is no shuffle of documents.

Results: one row per input row, repeated rows and null ids included. Null text
is empty: no spans. Without candidates no tree is fitted. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.llm.shared import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TRAIN = 8000
PRECISION = 0.95
ROUNDS, DEPTH = 8, 3
CONTEXT = 32
CHUNK = 256

# Same matches as the plain patterns. A run of digits (or of an email's first part) is tried at its start only:
# a later start in it would fail, or match less, in the same way; \G allows one right after the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
# a maximal run of 16 to 19 digits; shorter and longer ones fail as a whole
CARD = r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:[.,:][0-9]{1,3}+){3}+",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"[(0-9](?<![0-9][(0-9])(?:(?<=\()[0-9]{2,4}+\)|(?<=[0-9])[0-9]{1,3}+)(?:[\x20.-]?+\(?+[0-9]{2,4}+\)?+){1,5}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
}
#: What a text must hold for a pattern to be tried at all: one cheap pass spares most texts the others.
_NEEDS = {EMAIL: "@", PHONE: r"\+[0-9]", IP: r"[0-9]\.[0-9]", CARD: r"[0-9][\x20-]?[0-9]", WIDER["card"]: r"[0-9][\x20-]?[0-9]",
          WIDER["email"]: r"[\[(](?:at|AT)[\])]", WIDER["ip"]: r"[0-9][.,:][0-9]",
          WIDER["phone"]: r"[0-9][0-9]", WIDER["secret"]: r"[0-9]"}
_CREDENTIAL = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential)\x20?[=:]\x20?[\"']?$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[\x20./-][0-9]{1,2}[\x20./-][0-9]{1,2}|[0-9]{1,2}[\x20./-][0-9]{1,2}[\x20./-](?:19|20)[0-9]{2})$"
FEATURES = ("kind", "length", "digits", "letters", "upper", "others", "hexdigits", "runs", "plus", "at_word", "mail_word",
            "phone_word", "card_word", "net_word", "secret_word", "quoted", "within")


def made(shape: str, salt: int = 0) -> str:
    """A value of a shape: each 9 becomes a digit, h a hex digit, A and a letters drawn by a hash of shape and place."""
    kinds = {"9": "0123456789", "h": "0123456789abcdef", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}
    return "".join(kinds[c][crc32(f"{shape}:{salt}:{i}".encode()) % len(kinds[c])] if c in kinds else c
                   for i, c in enumerate(shape))


#: Labels that hold in any data: (kind, label, text before, said). Values without a meaning of their own are made by rule.
SEEDS = [
    *[("email", 1, b, x) for b in ("", "mail ", "write to ") for x in (
        "jane [at] example [dot] com", "j.doe(at)mail.example.org", "info[at]example[dot]co[dot]uk", "sam7 (at) example (dot) net")],
    *[("ip", 1, b, x) for b in ("", "host ", "from ") for x in ("10,0,0,1", "192:168:1:20", "203,0,113,77", "85:134:245:158")],
    *[("card", 1, b, x) for b in ("", "card ", "paid with ") for x in (
        "378282246310005", "3782 822463 10005", "4222222222222", "30569309025904")],
    *[("phone", 1, b, x) for b in ("", "call ", "tel. ", "reach me on ") for x in (
        made("(999) 555-9999"), made("999-555-9999"), made("999 555 9999"), made("030 9999999"), made("(030) 9999 9999"),
        made("555-9999"))],
    *[("phone", 0, b, x) for b in ("on ", "", "since ") for x in ("2021-03-11", "11.03.2021", made("240.59.129.199"))],
    *[("phone", 0, b, x) for b in ("id 5f0ab", "x", "v") for x in (made("9999999"), made("99999999"))],
    *[("secret", 1, b, x) for b in ("", "use ", "send ") for x in (
        made("h" * 40), made("h" * 40, 1), "sk_live_" + made("9aA9aA9aAa9AaA9aAa9A"), "AKIA" + made("9A9A9AA9A9A9A9AA9A9A"),
        "ghp_" + made("9aA9aAa9Aa9Aa9Aa9Aa9Aa9Aa9Aa9Aa9AaAaA"))],
    *[("secret", 0, b, x) for b in ("", "see ", "order ") for x in (
        made("9" * 16), "chapter-2-the-long-road-home", "page_section_12_title", "2021-03-11-report-final", "00000000000000001234")],
]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct(start, end, said[, before])> of the pattern's matches, in code points.

    Text between matches and matches themselves alternate, so lengths add up to
    places. They are added in chunks: growing one array match by match would cost
    the square of their number.
    """
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "struct<start:int,end:int,said:string" + (",before:string>" if context else ">")
    none = F.expr(f"cast(array() as array<{kind}>)")

    def step(s, p):
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["said"])
        more = [F.right(p["gap"], F.lit(CONTEXT)).alias("before")] if context else []
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), p["said"].alias("said"), *more))).alias("out"))

    def chunk(s, c):
        inner = F.aggregate(c, F.struct(s["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out")))

    def placed(pairs):
        # the last gap has no match after it
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 2) / CHUNK).cast("int")),
                            lambda i: F.slice(pairs, i * CHUNK + 1, F.least(F.lit(CHUNK), F.size(pairs) - 1 - i * CHUNK)))
        zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
        return F.when(F.size(pairs) > 1, F.flatten(F.aggregate(parts, zero, chunk)["out"])).otherwise(none)

    found = _let(F.arrays_zip(gaps.alias("gap"), said.alias("said")), placed)
    return F.when(text.rlike(_NEEDS[pattern]), found).otherwise(none)


def _digits(said: Column) -> Column:
    return F.translate(said, " -().+", "")


def _luhn_sum(said: Column) -> Column:
    d = F.split(F.reverse(_digits(said)), "")
    d = F.filter(d, lambda x: x != "")

    def value(x, i):
        n = x.cast("int") * (F.lit(1) + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(d, value), F.lit(0), lambda a, b: a + b)


def luhn(said: Column) -> Column:
    return _luhn_sum(said) % 10 == 0


def _small_parts(said: Column) -> Column:
    """Whether every part is at most 255, however many zeros lead it."""
    bare = F.transform(F.split(said, r"[.,:]"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))


def _checked(kind: str, spans: Column) -> Column:
    """The spans that pass their kind's check."""
    checks = {"ip": lambda s: _small_parts(s["said"]), "card": lambda s: luhn(s["said"])}
    return F.filter(spans, checks[kind]) if kind in checks else spans


def base_matches(text: Column) -> dict[str, Column]:
    """array<struct(start, end, said, before)> of each base kind, checked."""
    found = {k: _checked(k, _spans(text, p, context=True))
             for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}
    found["phone"] = F.filter(found["phone"], lambda s: F.length(_digits(s["said"])).between(8, 15))
    return found


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _features(kind: int, s: Column) -> Column:
    said, near = s["said"], F.lower(s["before"])
    count = lambda chars: (F.length(said) - F.length(F.regexp_replace(said, chars, ""))).cast("double")
    word = lambda p: _flag(near.rlike(p))
    # what a secret's label is taken from
    told = (lambda p: F.lit(0.0)) if KINDS[kind] == "secret" else word
    values = [
        F.lit(float(kind)), F.length(said).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"),
        count("[^A-Za-z0-9]"), count("[0-9a-fA-F]"),
        F.size(F.regexp_extract_all(said, F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("double"),
        word(r"\+[0-9]?\x20?$"), word(r"\b(?:at|dot)\b"), word("mail"), word("phone|call|tel|fax|mobile"),
        word("card|visa|credit|pay"), word(r"\bip\b|host|server|addr"), told("token|secret|passw|key|credential"),
        told("[\"']$"), word("[a-z0-9]$")]
    return F.array(values)


def _proposal(kind: int):
    def propose(s):
        secret, phone = KINDS[kind] == "secret", KINDS[kind] == "phone"
        assigned = F.coalesce(s["before"].rlike(_CREDENTIAL), F.lit(False)) if secret else F.lit(False)
        never = s["said"].rlike(_DATE) | s["before"].rlike("[A-Za-z0-9]$") if phone else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        _features(kind, s).alias("f"), assigned.alias("assigned"),
                        F.coalesce(never, F.lit(False)).alias("never"))
    return propose


def candidates(text: Column) -> Column:
    """array<struct(kind, start, end, f, assigned, never)> that the wider patterns propose, checked."""
    out = []
    for i, kind in enumerate(KINDS):
        spans = _checked(kind, _spans(text, WIDER[kind], context=True))
        if kind == "phone":
            spans = F.filter(spans, lambda s: F.length(_digits(s["said"])).between(7, 15))
        out.append(F.transform(spans, _proposal(i)))
    return F.concat(*out)


def _rewritten(kind: str, said: Column) -> Column:
    """A base match in one of the wider formats, chosen by its hash."""
    v = F.pmod(F.xxhash64(said), F.lit(4)).cast("int")
    if kind == "email":
        host = F.element_at(F.split(said, "@"), 2)
        return F.concat(F.element_at(F.split(said, "@"), 1), F.when(v < 2, " [at] ").otherwise("(at)"),
                        F.when(v == 0, F.regexp_replace(host, r"\.", " [dot] "))
                        .when(v == 2, F.regexp_replace(host, r"\.", "(dot)")).otherwise(host))
    if kind == "ip":
        return F.when(v < 2, F.translate(said, ".", ",")).otherwise(F.translate(said, ".", ":"))
    if kind == "card":
        body = F.substr(_digits(said), F.lit(1), F.lit(12) + F.least(v, F.lit(2)))
        return F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    home = F.regexp_replace(said, r"^\+[0-9]{1,2}[\x20.-]*", "")
    return F.when(v < 2, home).otherwise(F.regexp_replace(F.regexp_replace(home, "[()]", ""), r"[\x20.]+", "-"))


def _lessons(kind: int, matches: Column) -> Column:
    name = KINDS[kind]
    new = F.transform(matches, lambda s: F.struct(_rewritten(name, s["said"]).alias("said"), s["before"].alias("before")))
    new = F.filter(new, lambda s: s["said"].rlike(f"^(?:{WIDER[name]})$"))
    if name == "phone":
        new = F.filter(new, lambda s: F.length(_digits(s["said"])).between(7, 15))
    return F.transform(new, lambda s: F.struct(F.lit(kind).alias("kind"), _features(kind, s).alias("f")))


def lessons(matches: dict[str, Column]) -> Column:
    """array<struct(kind, f)> of the base matches rewritten into the wider formats."""
    return F.concat(*[_lessons(i, matches[k]) for i, k in enumerate(KINDS[:4])])


def seeds(spark) -> DataFrame:
    """SEEDS as labelled rows (kind, f, label, h)."""
    rows = []
    for i, kind in enumerate(KINDS):
        own = F.array(*[F.struct(F.lit(float(y)).alias("label"), F.lit(b).alias("before"), F.lit(x).alias("said"))
                        for k, y, b, x in SEEDS if k == kind])
        rows.append(spark.range(1).select(F.explode(own).alias("s")).select(
            F.lit(i).alias("kind"), _features(i, F.col("s")).alias("f"), F.col("s.label").alias("label"),
            F.xxhash64("s.before", "s.said").alias("h")))
    return reduce(DataFrame.unionByName, rows)


def _meets(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _tree(node, f: Column) -> Column:
    """A fitted tree's prediction as nested CASE expressions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), f)).otherwise(
        _tree(node.rightChild(), f))


def thresholds(bins) -> list[float]:
    """For each kind the score above which its candidates are taken, from rows (kind, s, pos, n)."""
    limits = []
    for kind in range(len(KINDS)):
        own = sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["s"])
        total = sum(r["pos"] for r in own)
        share = 1.0
        if KINDS[kind] == "secret" and total:  # the assigned among what looks like them
            share = sum(r["pos"] * r["pos"] / r["n"] for r in own) / total
        pos = n = 0
        limit = math.inf
        for r, low in zip(own, [*own[1:], None], strict=True):
            pos, n = pos + r["pos"], n + r["n"]
            if pos >= PRECISION * share * n:  # no label lies between this score and the next
                limit = (r["s"] + low["s"]) / 2 if low else -math.inf
        limits.append(limit)
    return limits


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN):
    """(score expression of a feature array, threshold of each kind).

    ``labelled``: kind, f (array), label (0.0 or 1.0), h (hash that draws and orders) of all texts.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    fixed = seeds(labelled.sparkSession)
    most = max_train // (2 * len(KINDS))  # of one kind and label
    counts = labelled.groupBy("kind", "label").count().collect()
    drawn = reduce(lambda rest, r: F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), F.lit(
        min(1.0, most / r["count"]))).otherwise(rest), counts, F.lit(1.0))
    train = labelled.where(F.pmod(F.col("h"), F.lit(1 << 30)) < drawn * (1 << 30)).unionByName(fixed)
    train = train.coalesce(1).sortWithinPartitions("h", "kind", "label").select(array_to_vector("f").alias("features"), "label")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(train)
    trees = [(t.rootNode(), float(w)) for t, w in zip(model._java_obj.trees(), model.treeWeights, strict=True)]

    def score(f: Column) -> Column:
        return F.round(reduce(lambda a, b: a + b, [_tree(root, f) * w for root, w in trees]), 3)

    bins = labelled.unionByName(fixed).select("kind", "label", score(F.col("f")).alias("s")).groupBy("kind", "s").agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()  # scores have three decimals
    return score, thresholds(bins)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, email, ip, card, phone, added): base spans by kind and added spans (kind, start, end)."""
    run = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = KINDS[:4]
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", *[v.alias(k) for k, v in base_matches(F.col("text")).items()], candidates(F.col("text")).alias("cands"))
    found = run.keep(found.select(
        "doc_id", *[F.transform(k, lambda s: F.struct(s["start"], s["end"])).alias(k) for k in base], "cands",
        lessons({k: F.col(k) for k in base}).alias("lessons")), "spans")
    own = reduce(lambda rest, i: F.when(F.col("c.kind") == i, _meets(F.col("c"), F.col(KINDS[i]))).otherwise(rest),
                 range(4), F.lit(False))
    every = F.concat(*[F.col(k) for k in base])
    given = F.transform(F.filter("cands", lambda c: c["assigned"]), lambda c: F.struct(c["start"], c["end"]))
    other = _meets(F.col("c"), F.concat(every, given))
    h = F.xxhash64("doc_id", "c.kind", "c.start", "c.end").alias("h")
    seen = (found.where(F.size("cands") > 0).select("*", F.explode("cands").alias("c")).where(~own)
            .where(F.col("c.assigned") | F.col("c.never") | (F.col("c.kind") == KINDS.index("secret")) | other)
            .select("c.kind", "c.f", F.col("c.assigned").cast("double").alias("label"), h))
    taught = (found.where(F.size("lessons") > 0).select("doc_id", F.posexplode("lessons").alias("at", "c"))
              .select("c.kind", "c.f", F.lit(1.0).alias("label"), F.xxhash64("doc_id", "c.kind", "at").alias("h")))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    if found.where(F.size("cands") > 0).isEmpty():
        return found.select("doc_id", *base, none.alias("added"))
    score, limits = fit(seen.unionByName(taught), max_train)
    limit = F.array(*[F.lit(x) for x in limits])
    good = lambda c: (score(c["f"]) > F.element_at(limit, c["kind"] + 1)) & ~_meets(c, given)
    added = F.transform(F.filter("cands", lambda c: ~_meets(c, every) & (c["assigned"] | good(c))),
                        lambda c: F.struct(c["kind"], c["start"], c["end"]))
    return found.select("doc_id", *base, added.alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """Text with the spans (array<struct(start, end)>) masked by one X a code point, overlaps included."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                 F.repeat(F.lit("X"), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0)))).alias("out")))
    return F.concat(done["out"], F.substr(text, done["at"] + 1))


def _told(kind: Column, s: Column) -> Column:
    return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, hash of the base spans, and all spans as text."""
    def told(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: _told(F.lit(kind), s))

    def added(i: int) -> Column:
        return F.transform(F.filter("added", lambda a: a["kind"] == i),
                           lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))

    base = KINDS[:4]
    every = [told(F.array_sort(F.array_distinct(F.concat(F.col(k), added(i)) if k in base else added(i))), k)
             for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(F.concat(*[told(F.col(k), k) for k in base]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*every), ",").alias("spans"))


def query(spark, sf_dir):
    """Personal data of every document."""
    return digests(find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))
