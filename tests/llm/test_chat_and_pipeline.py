"""Reply trees round trip; the pipeline's stages in order."""

import hashlib
import re

import corpus_pipeline
from streakline.llm import chat_format as cf

SF = "/root/testdata/sf0.001"
SAID = ["</s>[INST] ok [/INST]", "", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|x <|", "é𝄞\n\n", "[\\INST] \\ $1"]


def flat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")


def test_linear_round_trip(spark):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", SAID[(i + c) % len(SAID)], "clash")
            for c in range(5) for i in range(c * 3 + 1)]
    rows += [(None, 0, "user", "x", "c"), (9, 0, "user", "same", "c"), (9, 0, "user", "same", "c"), (10, None, None, None, "c")]
    got = {r["conv_id"]: r for r in cf.digests(cf.format_trees(cf.linear(flat(spark, rows)))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1]))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learn = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(all_.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(learn))
        assert got[c]["loss_sha256"] == hashlib.sha256(learn.encode()).hexdigest()


def test_trees_rank_and_cycles(spark):
    nodes = [(1, "a", None, "user", "hi", 0.0), (1, "b", "a", "assistant", "low", 0.1), (1, "c", "a", "assistant", "high", 0.9),
             (1, "d", "c", "user", "more", 0.0), (1, "e", "gone", "user", "orphan", 0.2),
             (2, "x", "y", "user", "loop", 9.0), (2, "y", "x", "user", "loop", 9.0), (2, "z", "y", "user", "leaf on a loop", 9.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node string, parent string, role string, text string, score double")
    every = {r["path"]: r["formatted"] for r in cf.format_trees(df).collect()}
    assert set(every) == {"b", "d", "e"}
    assert [t[1] for t in re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>", every["d"])] == ["hi", "high", "more"]
    best = [r["path"] for r in cf.format_trees(df, top=1).collect()]
    assert best == ["d"]


def test_empty_conversations(spark):
    assert cf.digests(cf.format_trees(cf.linear(flat(spark, [])))).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF).cache()
        assert d.columns == columns, name
        counts.append(d.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2]
    packed = corpus_pipeline.run(spark, SF).collect()
    ids = {p["doc_id"] for r in packed for p in r["pieces"]}
    assert ids == {r["doc_id"] for r in d.where("text <> ''").collect()}
