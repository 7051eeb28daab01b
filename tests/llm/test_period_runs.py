"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streakline.llm import period_runs as P


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            size = e + q - i
            part = w[i:e + q]
            least = next(p for p in range(1, size + 1) if part[p:] == part[:size - p])
            if least == q and size >= max(6, 4 * q):
                out.append((i, size, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def found(texts):
    names, offs = [], [0]
    for t in texts:
        names += t
        offs.append(len(names))
    s, size, q = P.find_runs(np.array(names, np.int64), np.array(offs, np.int64))
    return list(zip(s.tolist(), size.tolist(), q.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_equal_brute_force(texts):
    at, want = 0, []
    for t in texts:
        want += [(s + at, size, q) for s, size, q in brute_runs(t)]
        at += len(t)
    assert found(texts) == want


@pytest.mark.parametrize("seed", range(30))
def test_long_periods_equal_brute_force(seed):
    r = random.Random(seed)
    t = []
    while len(t) < 300:
        unit = [r.randrange(4) for _ in range(r.randrange(1, 30))]
        t += unit * r.randrange(1, 8) + unit[:r.randrange(len(unit))]
    assert found([t]) == brute_runs(t)


def test_rows_equal_brute_force(spark):
    r = random.Random(7)
    texts = [None, "", " \t\n", "a", "x " * 40, "é ü " * 5 + "ende", "a b c " * 4, "a b c " * 3,
             "ab ab ab ab ab ab\tcd\ncd cd cd cd cd", "\x00 \x00 \x00 \x00 \x00 \x00 z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q q q q q q q")] + [(3, "a"), (3, "a")]
    rows += [(1000 + i, " ".join(r.choice("abcd") + r.choice(["", ",", "ß"]) for _ in range(r.randrange(400))))
             for i in range(300)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, runs string, best int")
    got = [tuple(x) for x in P.digests(P.periodic_runs(df, plant=True)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted((brute_row(*x) for x in rows), key=key)


def test_empty_table_and_plain_runs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(P.periodic_runs(empty)).collect() == []
    row = P.periodic_runs(spark.createDataFrame([(1, "to be or " * 6 + "not")], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.runs] == [(0, 18, 3)] and row.collapsed == "to be or not"


def test_very_long_text(spark):
    words = ["w%d" % (i % 9973) for i in range(400_000)]
    row = P.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.runs] == [(0, 400_000, 9973)]
    assert row.collapsed == " ".join(words[:9973])
