"""The prefix trie against brute force."""

import hashlib
import heapq
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import pytest

from streakline.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, said), (role, text)))
    own = {c: [x[1] for x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        seqs[c] = own.get(c - c % 100, [])[:h] + turns[h:] if heads else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def total(p):
        mine = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below = [total(k) for k in kids[p]]
        return sum(b[0] for b in below) or 1, mine + sum(b[1] for b in below)

    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), *total(p), hashlib.sha256(
        ",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, n, deep=6):
    r = random.Random(seed)
    out = []
    for c in range(n):
        c = r.choice([c, c * 37, 100 * c])
        for turn in range(r.randrange(1, deep)):
            out.append((c, r.choice([turn, turn, None]), r.choice(["user", None]), r.choice(["a", "bé", "", None])))
    return out + out[:3] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("heads,shard_rows,queue_rows", [(True, None, T.QUEUE_ROWS), (True, 3, 2), (False, 20, 1)])
def test_equals_brute_force(spark, heads, shard_rows, queue_rows):
    rows = made(5, 120)
    df = spark.createDataFrame([(*x, "clash", b"1", 2) for x in rows], SCHEMA + ", node string, parent binary, i int")
    turns = T.ordered_turns(df)
    trie = T.prefix_trie(*(T.with_shared_heads(turns) if heads else T.as_sequences(turns)), shard_rows, queue_rows)
    assert rows_of(trie) == brute(rows, heads)


def test_hot_turn_and_long_conversation(spark):
    rows = [(c, 0, "user", "hello") for c in range(400)] + [(c, 1, "assistant", str(c % 7)) for c in range(400)]
    rows += [(900, i, "user", "x") for i in range(600)] + [(901, i, "user", "x") for i in range(599)]
    turns = T.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = rows_of(T.prefix_trie(*T.as_sequences(turns), shard_rows=700, queue_rows=5))
    tops = {r[1]: r for r in got if r[0] == 0}
    assert tops[0][3:7] == (402, 2, 8, 401 * 0 + 399 * 5 + sum(n - 1 for n in [58, 57, 57, 57, 57, 57, 57]) + 599)
    assert tops[1][3:5] == (400, 7) and len(got) == 1 + 1 + 7 + 600


def test_empty_and_turnless(spark):
    empty = T.ordered_turns(spark.createDataFrame([], SCHEMA))
    assert T.prefix_trie(*T.with_shared_heads(empty)).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]  # its head is absent and its own turn lies within it
    got = rows_of(T.prefix_trie(*T.with_shared_heads(T.ordered_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == brute(rows, True) and got[0][1] == 0 and len(got) == 1


def test_sql_equals_brute_force(spark):
    rows = made(9, 60)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = [tuple(-1 if x is None else x for x in r) for r in con.sql(
        f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({T.ORACLE})")
        .fetchall()]
    assert sorted(got) == brute(rows, True)


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
def test_spilling_queue_equals_heap(limit):
    r = random.Random(limit)
    queue, heap = T.SpillingQueue(8, limit), []
    for _ in range(4000):
        if r.random() < 0.6 or not heap:
            x = struct.pack(">Q", r.randrange(500))
            queue.push(x)
            heapq.heappush(heap, x)
        else:
            assert queue.peek() == heap[0]
            assert queue.pop() == heapq.heappop(heap)
    while heap:
        assert queue.pop() == heapq.heappop(heap)
    assert queue.peek() is None and len(queue.runs) <= 33
    assert (queue.spilled > 0) == (limit < 1000)


@pytest.mark.parametrize("broadcast", ["64k", "128k", "256k", "512k"])
def test_heads_and_own_turns_meet(spark, tmp_path, broadcast):
    names = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k) for k in names}
    spark.range(25_000).selectExpr("id AS conv_id", "explode(sequence(0, 5)) AS i").selectExpr(
        "conv_id", "CAST(i AS long) AS i", "unhex(md5(concat(conv_id, ':', i))) AS turn_hash", "1L AS chars").write.parquet(str(tmp_path / "t"))
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        convs, sequences = T.with_shared_heads(spark.read.parquet(str(tmp_path / "t")))
        T.chains(sequences).write.parquet(str(tmp_path / "c"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    chain = spark.read.parquet(str(tmp_path / "c"))
    assert chain.count() == 150_000
    assert chain.where(f"depth > 1 and parent = unhex('{T.ROOT.hex()}')").count() == 0
