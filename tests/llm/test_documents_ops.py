"""The operators on documents against brute force: odd rows, ties, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from streakline.llm import (langid, license_scan, line_dedup, ngram_jaccard, packing, pii, quality, suffix_dedup,
                            winnowing)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, site string, line long"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{zlib.crc32(str(i).encode()) % 5000}" for i in range(40000))
EN = "the quick people of this town and the river that runs for a while with all of it on the hill "
DE = "die alten Leute und der Fluss mit dem Boot auf dem Weg in das Tal und nicht zu den Bergen von "


def rows():
    base = EN + " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "other ")
    texts = [None, "", "   \n\t", "one", "one two", base, base, near, LONG, LONG + " end", base.upper(),
             "menu home about\nunique a\nmenu home about", "menu home about\nunique b", "x" * 5000, "é𝄞ü " * 40,
             DE * 5, EN * 5, "a@b.co called +1 (614) 555-8001 from 10.0.0.1 with 4111 1111 1111 1111",
             "Released under the MIT License.\n" + EN, "\n\n\n", "12 34 " * 50, "### $$$ %%%"]
    out = [(i, t, "de" if t and t.startswith("die") else "en", f"s{i % 4}") for i, t in enumerate(texts)]
    out += [(6, base, "en", "s2"), (None, base, None, None), (None, None, None, None), (40, "menu home about\nz", "xx", "s3")]
    return [(*r, 1, "clash", "clash", 7) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- quality

def test_quality_base_counts(docs):
    def expect(t):
        ws = words(t)
        seen, dup = set(), 0
        for ln in (t or "").split("\n"):
            if words(ln):
                dup += ln in seen
                seen.add(ln)
        n = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
        hit = set()
        for i in range(len(ws) - 7):
            if n[tuple(ws[i:i + 8])] > 1:
                hit |= set(range(i, i + 8))
        return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit),
                len(ws) < 20 or 100 * len(hit) > 30 * len(ws))

    got = Counter(tuple(r)[:7] for r in quality.judge(docs).collect())
    assert got == Counter((r[0], *expect(r[1])) for r in rows())


def test_quality_distance_and_guards(docs):
    out = {r["doc_id"]: r for r in quality.judge(docs).collect() if r["doc_id"] is not None}
    assert out[3]["char_distance"] is None and out[13]["word_distance"] is None  # too short to judge
    assert all(not r["kept"] for r in out.values() if r["base_failed"])
    import numpy as np
    p, q = np.array([[3.0, 1.0]]), np.array([[1.0, 1.0]])
    m = (p / 4 + q / 2) / 2
    want = math.sqrt(sum(x * math.log2(x / y) for x, y in zip([.75, .25], m[0])) / 2
                     + sum(x * math.log2(x / y) for x, y in zip([.5, .5], m[0])) / 2)
    assert abs(quality.js_distance(p, q)[0] - want) < 1e-12


# ---- near duplicates

def shingles(t):
    ws = words(lower(t))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(rs):
    sets = [shingles(r[1]) for r in rs]
    group = list(range(len(rs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in combinations(range(len(rs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rs):
        if r[0] is not None:
            low[find(i)].append(r[0])
    return [(r[0], len(sets[i]), r[0] if not sets[i] else min(low[find(i)], default=None)) for i, r in enumerate(rs)]


def test_near_duplicates_match_brute_force(docs):
    got = Counter(tuple(r)[:3] for r in ngram_jaccard.jaccard_components(docs).collect())
    assert got == Counter(brute_components(rows()))


def test_near_duplicates_over_many_sizes(spark):
    out = []
    for n in (8, 20, 60, 127, 128, 129, 260, 600, 1500):
        ws = [f"v{n}x{i}" for i in range(n)]
        for k in (0, 1, 2, 3, n // 50 + 1, n // 30 + 1, n // 20):
            out.append((len(out), " ".join("z" + w if k and i % max(1, n // k) == 3 else w for i, w in enumerate(ws))))
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in ngram_jaccard.jaccard_components(df).collect())
    assert got == sorted(brute_components(out))


def test_one_of_each_group_stays(docs):
    out = ngram_jaccard.near_duplicates_out(docs)
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert {0, 1, 2, 3, 4, 5, 8} <= set(left) and not {6, 7, 9, 10} & set(left)


# ---- licenses

def test_license_wording(spark):
    texts = ["Released under the MIT License.", "prose before. Licensed under CC BY-NC 4.0. And prose after.",
             "This work is licensed under the GNU General Public License, version 3.",
             "This work is licensed under the GNU General Public License, version 7.",
             "he had a driving license and permission to park", None, "", "x " * 50000 + "Released under the MIT License.",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction,\n"
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,\n"
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,\n"
             "subject to the following conditions:"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert [got[i]["licenses"] for i in range(9)] == ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "", "", "", "", "MIT", "MIT"]
    span = got[1]["spans"][0]
    assert texts[1][span["start"]:span["end"]] == "Licensed under CC BY-NC 4.0"
    assert got[8]["n_different"] == 0 and got[5]["n_blocks"] == 0


def test_every_license_of_a_block(spark):
    named = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
             "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    prose = (EN + "permission is granted to copy modify and distribute the software in the public domain for any person ") * 6
    df = spark.createDataFrame([(0, " ".join(named)), (1, prose + named[4])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert got[0]["licenses"] == "Apache-2.0,CC-BY-4.0,CC-BY-NC-4.0,CC-BY-SA-4.0,GPL-3.0,MIT,Proprietary"
    assert got[0]["n_confirmed"] == 7 and got[0]["n_different"] == 0
    assert got[1]["licenses"] == "Proprietary"


def test_every_notice_of_a_block(spark):
    def gpl(v, do="redistribute"):
        return (f"This program is free software; you can {do} it and/or modify it under the terms of the GNU General Public "
                f"License as published by the Free Software Foundation; either version {v} of the License, or (at your "
                "option) any later version.")

    mit = "Released under the MIT License."
    texts = [f"{mit}\nfile one\n{mit}\nfile two\n{mit}", f"{gpl(2)}\n{gpl(2)}\n{gpl(2, 'copy')}",
             f"{gpl(2, 'pass on copies of')}\nand of the other part:\n{gpl(3).replace(';', ':', 1)}", f"{mit} " * 700, f"{gpl(2)}\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert [texts[0][s["start"]:s["end"]] for s in got[0]["spans"]] == [mit[:-1]] * 3
    assert got[1]["licenses"] == "GPL-2.0" and [s["different"] for s in got[1]["spans"]] == [0, 0, 1]
    assert [(s["license"], s["different"] > 0) for s in got[2]["spans"]] == [("GPL-2.0", True), ("GPL-3.0", False)]
    assert got[3]["n_confirmed"] == 700 and got[4]["n_confirmed"] == 40 and got[4]["n_different"] == 0


# ---- repeated strings

def brute_repeats(rs, n):
    out, seen = {}, set()
    for i, t in sorted(rs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - n + 1):
            w = data[s:s + n]
            if w in seen:
                gone[s:s + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    base = [(r[0], r[1]) for r in rows() if r[0] is not None and r[0] != 6 and not (r[1] or "").startswith("w")]
    part = LONG[:900]
    base += [(100, "aa " + part + " bb " + part[:250]), (101, "é" * 300), (102, "y" + part[50:400] + "é" * 120),
             (103, "ab" * 400), (104, "z" + "ab" * 130)]
    df = spark.createDataFrame(base, "doc_id long, text string")
    got = {r["doc_id"]: (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(base, 100)


def test_repeats_of_hot_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # the way of very frequent strings
    part = LONG[:300]
    base = [(i, f"doc {i} {LONG[400 + 9 * i:520 + 9 * i]} {part} {i * 7}") for i in range(12)]
    df = spark.createDataFrame(base, "doc_id long, text string")
    got = {r["doc_id"]: (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(base, 100)


def test_repeats_of_copies_in_several_partitions(spark):
    families = []
    for f in range(24):
        a, b, part = (" ".join(f"{x}{zlib.crc32(f'{f} {x} {i}'.encode()) % 10 ** 6}" for i in range(40)) for x in "abc")
        families.append((f"{a} {part} {b}", f"{b[::-1]} {part} {a[::-1]}", f"{a[::-1]} {part[:150]} {b[::-1]}"))
    # the slices of the list are partitions: copies of one text meet only after the shuffle
    base = [(1000 * c + f, t[0]) for c in range(4) for f, t in enumerate(families)]
    base += [(9000 + 10 * f + i, t[i]) for f, t in enumerate(families) for i in (1, 2)]
    df = spark.createDataFrame(base, "doc_id long, text string")
    got = {r["doc_id"]: (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(base, 100)


# ---- benchmark passages

def brute_hits(text, items):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, who = set(), set()
    for i, t in items:
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(10, len(want))
        for a in range(len(want) - n + 1 if n else 0):
            for b in range(len(ws) - n + 1):
                if ws[b:b + n] == want[a:a + n]:
                    hit |= set(range(b, b + n))
                    who.add(i)
    ids = ",".join(sorted(map(str, who)))
    return len(ws), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [winnowing.BLOCK_WORDS, 20])
def test_benchmark_passages(spark, block):
    item = " ".join(f"t{i}" for i in range(25))
    items = [(1, item), (2, "short item here"), (3, None), (4, "!!!"), (15, item), (7, " ".join(item.split()[5:17]))]
    docs = [(0, item), (1, "pre " + " ".join(item.split()[3:13]) + " post"), (2, " ".join(item.split()[3:12])),
            (3, "a SHORT, item; here b"), (4, None), (5, ""), (6, "clean words only"), (None, item), (6, "clean words only")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in winnowing.decontaminate(d, b, block_words=block).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in docs)
    clash = d.withColumn("t", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("a b.c", F.lit(3))
    left = winnowing.clean_documents(clash, b, block_words=block)
    assert left.columns == clash.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 6]


def test_joined_benchmark_equals_broadcast_one(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    few_bits = 1 << 15  # many windows pass a full bitmap, none may stay
    a, c = (winnowing.decontaminate(d, b, block_words=n, filter_bits=few_bits) for n in (winnowing.BLOCK_WORDS, 0))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, c.collect()))
    assert a.where("contaminated").count() > 0
    # a benchmark as large as the documents, in which every document finds itself
    own = d.select(F.col("doc_id").alias("item_id"), "text")
    got = winnowing.decontaminate(d, own, block_words=0)
    assert got.where("n_words > 0 and (n_hit < n_words or n_items = 0)").count() == 0


# ---- language

def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    # a tenth lose their declared language and source; the text has to tell
    held = F.col("doc_id") % 10 == 0
    items = langid.document_items(d.withColumn("lang0", F.col("lang")).withColumn("lang", F.when(~held, F.col("lang")))
                                  .withColumn("source", F.when(~held, F.col("source"))))
    got = {r["doc_id"]: r for r in langid.identify(items, ["doc_id"]).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    asked = [i for i in truth if i % 10 == 0]
    assert sum(got[i]["language"] == truth[i] for i in asked) >= 0.95 * len(asked)
    assert sum(r["kept"] for r in got.values()) >= 0.99 * len(got)


def test_language_evidence_settles_short_texts(spark):
    many = [(i, EN * 3, "en", "a.example.com") for i in range(30)] + [(100 + i, DE * 3, "de", "b.example.de") for i in range(30)]
    odd = [(200, "in", "de", "b.example.de"), (201, "in", "en", "a.example.com"), (202, None, "en", "a.example.com"),
           (203, "12 34 ##", None, None), (204, "ጀኘጁጂጃጄጅጆጇገጉጊጋጌግጎጏጐጒጓጔጕ " * 40, None, None)]
    df = spark.createDataFrame(many + odd, "doc_id long, text string, declared string, host string")
    df = df.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    got = {r["doc_id"]: r for r in langid.identify(df, ["doc_id"]).collect()}
    assert got[200]["language"] == "de" and got[201]["language"] == "en"
    assert [got[i]["kept"] for i in (202, 203, 204)] == [False, False, False]
    assert got[202]["confidence"] == 0.0 and got[204]["language"] == "und"


def test_language_of_pages(spark):
    df = spark.createDataFrame([(1, "https://Blog.Example.co.uk:80/x", "<html lang='de'><script>var x='<p>'</script><p>Hallo &amp; du</p>"),
                                (2, None, None)], "page_id long, url string, html string")
    a, b = langid.page_items(df).orderBy("page_id").collect()
    assert (a["declared"], a["host"], a["domain"], a["suffix"]) == ("de", "blog.example.co.uk", "co.uk", "uk")
    assert a["text"].split() == ["Hallo", "du"] and b["host"] is None and b["declared"] is None


# ---- packing

def test_packing_places_every_byte_once(docs):
    placed = packing.best_fit(packing.lengths_of(docs), (256, 1024, 4096), 10).collect()
    want = Counter()
    for r in rows():
        if r[1]:
            want[r[0]] += len(r[1].encode()) + 1
    got = Counter()
    bins = defaultdict(list)
    for p in placed:
        got[p["doc_id"]] += p["length"]
        bins[p["bin_id"]].append(p)
    assert got == want
    for ps in bins.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["place"]):
            assert p["place"] == at
            at += p["length"]
        assert at == ps[0]["used"] <= ps[0]["capacity"] and ps[0]["capacity"] == min(c for c in (256, 1024, 4096) if c >= at)


def test_packing_rules():
    where, size, used = packing.pack([900, 700, 300, 120, 100], (1024, 2048))
    assert sorted(used) == sorted(sum(n for n, b in zip([900, 700, 300, 120, 100], where) if b == x) for x in set(where))
    where, size, used = packing.pack([900, 100], (1024, 2048))
    assert size == [1024] and used == [1000]  # the least-cost bin, and shrunk
    tight = packing.pack([600, 500, 400, 400], (1024,))
    assert tight[0][2] == 0 and tight[0][3] == 1  # best fit: the fuller bin first


def test_packed_texts_round_trip(docs, spark):
    d = docs.where("doc_id is not null and doc_id <> 6")
    out = packing.sequence_texts(packing.best_fit(packing.lengths_of(d), (512, 4096)), d).collect()
    placed = packing.best_fit(packing.lengths_of(d), (512, 4096)).orderBy("doc_id", "copy", "piece").collect()
    content = {r["bin_id"]: bytes(r["content"]) for r in out}
    back = defaultdict(bytes)
    for p in placed:
        back[p["doc_id"]] += content[p["bin_id"]][p["place"]:p["place"] + p["length"]]
    assert dict(back) == {r[0]: r[1].encode() + b"\n" for r in rows() if r[0] not in (None, 6) and r[1]}


def test_token_lengths(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in packing.lengths_of(df, ranks=path).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


# ---- lines

def brute_lines(rs, k):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    sites, first = defaultdict(set), {}
    for r in rs:
        for p, ln in enumerate(r[1].split("\n") if r[1] is not None else []):
            key = lower(ln).strip(strip)
            if key:
                sites[key].add(r[3])
                place = (math.inf if r[0] is None else r[0], p)
                first[key] = min(first.get(key, place), place)
    out = []
    for r in rs:
        lines = r[1].split("\n") if r[1] is not None else []
        place = math.inf if r[0] is None else r[0]
        keep = [ln for p, ln in enumerate(lines) if not (
            (key := lower(ln).strip(strip)) and len(sites[key]) >= k and first[key] != (place, p))]
        out.append((r[0], len(lines), len(lines) - len(keep), "\n".join(keep) if r[1] is not None else None))
    return out


@pytest.mark.parametrize("bound, k", [(line_dedup.BROADCAST_LINES, 2), (line_dedup.BROADCAST_LINES, 4), (0, 3)])
def test_boilerplate_lines(docs, bound, k):
    out = line_dedup.remove_boilerplate(docs, k, broadcast_lines=bound)
    assert out.columns == [*docs.columns, "__lines", "__gone"]
    got = Counter((r["doc_id"], r["__lines"], r["__gone"], r["text"]) for r in out.collect())
    assert got == Counter(brute_lines(rows(), k))


def test_line_estimates_near_the_threshold_are_exact(spark):
    lines = [(i * 100 + s, f"line {i}", f"site{s}") for i in range(30) for s in range(85 + i)]
    df = spark.createDataFrame(lines, "doc_id long, text string, source string")
    got = line_dedup.remove_boilerplate(df, 100).agg(F.sum("__gone").alias("g")).first()["g"]
    want = sum(85 + i - 1 for i in range(30) if 85 + i >= 100)
    assert got == want


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def base_spans(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


ODD = ["a@b.c@d.e a@b.c-x_y@d.e..x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004 1.1.1.1.", "x" * 30000 + "@",
       "4111 1111 1111 1111 4111-1111-1111-1111-5 4111  1111", "+1 (614) 555-8001 +1+2 +12 +49 30 1234567.",
       "é𝄞 +1 (614) 555-8001 a@b.co 𝄞", "1" * 20000, "1." * 9000, "a.a" * 9000 + "@b" + ".c" * 3000,
       "+1" + " " * 30000, "12 34 " * 3000, "%20a@b.c%a@b.c-@x.y", "4111111111111111 " * 200]


def test_base_spans_match_brute_force(docs, spark):
    both = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = Counter()
    for r in pii.digests(pii.find_spans(both)).collect():
        got[(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])] += 1
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows()] + [(1000 + i, t) for i, t in enumerate(ODD)]:
        b = base_spans(t)
        want[(i, *(sum(x[0] == k for x in b) for k in PATTERNS),
              hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest())] += 1
    assert got == want


def test_trees_add_secrets_and_keep_base(spark):
    out = []
    for i in range(400):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        out.append((i, f'the token = "{h[:40]}" was here' if i % 2 else f"build {h[:20]} of 2021-{i % 12 + 1:02d}-11 at row {h[:24]}"))
    got = {r["doc_id"]: r for r in pii.digests(pii.find_spans(spark.createDataFrame(out, "doc_id long, text string"))).collect()}
    assert all(got[i]["spans"] == "secret:13:53" for i in range(1, 400, 2))
    assert sum("secret" in got[i]["spans"] for i in range(0, 400, 2)) <= 10


def check_digit(body):
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def test_wider_formats_are_added(spark):
    out = []
    for i in range(240):
        n = zlib.crc32(str(i).encode())
        key = hashlib.sha256(str(i).encode()).hexdigest()[:40]
        out.append((i, f"the people write u{n}@mail{i % 7}.example.com and +1 (614) 555-{i + 8000} from 10.{i}.0.{n % 250} "
                       f"with {check_digit(str(4 * 10 ** 14 + n))} on 2021-03-{i % 28 + 1:02d}" + (f' token = "{key}"' if i % 2 else "")))
    new = {"email": "jane [at] example [dot] com", "phone": "(614) 555-8123", "card": check_digit("37828224631000"),
           "ip": "10,20,30,40", "secret": hashlib.sha256(b"x").hexdigest()[:40]}
    out += [(1000 + i, f"the people say {x} and go") for i, x in enumerate(new.values())]
    out += [(2000, "the people came on 2021-03-11 and went")]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_spans(
        spark.createDataFrame(out, "doc_id long, text string"))).collect()}
    for i, (kind, x) in enumerate(new.items()):
        assert f"{kind}:15:{15 + len(x)}" in got[1000 + i].split(","), kind
    assert got[2000] == ""


def test_rare_kinds_among_many_numbers(spark):
    new = ["jane [at] example [dot] com", "(614) 555-8123", check_digit("37828224631000"), "10,20,30,40"]
    rare = [(9000 + i, f"the people say {x} and go") for i, x in enumerate(new)]
    many = [(i, f"row {10 ** 15 + 7919 * i} of {hashlib.sha256(str(i).encode()).hexdigest()[:24]}") for i in range(600)]
    for rows_, most in ((rare, 8000), (rare + many, 100)):  # alone, and as a few of many candidates
        got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_spans(
            spark.createDataFrame(rows_, "doc_id long, text string"), max_train=most)).collect()}
        for i, (kind, x) in enumerate(zip(("email", "phone", "card", "ip"), new)):
            assert f"{kind}:15:{15 + len(x)}" in got[9000 + i].split(","), kind


def test_redaction(spark):
    df = spark.createDataFrame([("é𝄞 mail a@b.co now",)], "text string").select(
        pii.redact(F.col("text"), F.expr("array(struct(8 as start, 14 as end), struct(10 as start, 16 as end))")).alias("t"))
    assert df.first()["t"] == "é𝄞 mail XXXXXXXXow"


# ---- all

def test_empty_tables(none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.judge(none).count() == 0
    assert ngram_jaccard.jaccard_components(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert winnowing.decontaminate(none, bench).count() == 0
    assert langid.identify(langid.document_items(none), ["doc_id"]).count() == 0
    assert langid.in_known_language(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert line_dedup.remove_boilerplate(none).count() == 0
    assert pii.digests(pii.find_spans(none)).count() == 0


def test_near_duplicates_are_judged_by_row(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten",
               "red green blue white black pink grey brown gold teal")
    rows = [(1, a, 0), (2, b, 0), (2, c, 0), (3, b + " x", 0)]
    schema = "doc_id long, text string, mark int"
    out = ngram_jaccard.near_duplicates_out(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in out.collect()) == sorted(rows[:3])
    rows = [(1, a, 0), (2, a + " x", 0), (2, b, 0)]
    assert sorted(tuple(r) for r in ngram_jaccard.near_duplicates_out(spark.createDataFrame(rows, schema)).collect()) == [
        (1, a, 0), (2, b, 0)]
    # equal rows, null ids, no words; of the same text under the same id one stays
    rows = [(5, a, 2), (5, a, 1), (None, a, 3), (None, b, 4), (None, b, 5), (7, None, 6), (7, None, 6), (8, " ", 7), (None, "", 8)]
    got = ngram_jaccard.near_duplicates_out(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(
        [(5, a, 1), (None, b, 4), (7, None, 6), (7, None, 6), (8, " ", 7), (None, "", 8)], key=key)


def test_near_duplicates_with_clashing_names(spark):
    names = ["id", "_id", "mark", "first", "jid", "jmark", "r", "label", "cls", "best", "n", "__row", "__keep", "doc id.x"]
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z")], "doc_id long, text string")
    for i, n in enumerate(names):
        df = df.withColumn(n, F.lit(i))
    out = ngram_jaccard.near_duplicates_out(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    none = ngram_jaccard.near_duplicates_out(df.where("false"))
    assert none.columns == df.columns and none.collect() == []


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_LINES, 0])
def test_lines_and_languages_with_clashing_names(spark, bound):
    names = ["__doc", "__t", "__lines", "__GONE", "__cut", "__cd", "__ct", "__none", "__m", "__mark", "mark", "doc id.x"]
    df = spark.createDataFrame([(1, EN + "\nmenu", "en", "a"), (2, EN + "x\nmenu", "en", "b")],
                               "doc_id long, text string, lang string, source string")
    for i, n in enumerate(names):
        df = df.withColumn(n, F.lit(i))
    out = line_dedup.remove_boilerplate(df, 2, broadcast_lines=bound)
    assert out.columns == [*df.columns, "___lines", "___gone"]
    assert sorted((r["doc_id"], r["__lines"], r["doc id.x"], r["___gone"]) for r in out.collect()) == [(1, 2, 11, 0), (2, 2, 11, 1)]
    known = langid.in_known_language(df)
    assert known.columns == df.columns and known.count() == 2


def test_seeds_are_not_lifted_from_documents(spark):
    """No made seed value stands in the documents."""
    made = [x for _, _, _, x in pii.SEEDS if sum(c.isalnum() for c in x) >= 10 and any(c.isdigit() for c in x)]
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(
        " or ".join(f"contains(text, '{x}')" for x in sorted(set(made))))
    assert found.count() == 0
