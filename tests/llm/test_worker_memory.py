"""Python workers keep no memory between tasks, and language ID works on small blocks."""

import numpy as np
import pyarrow as pa

from streakline.llm import langid, shared


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    assert list(shared.lean(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and len(calls) == 1
    stopped = shared.lean(lambda batches: (x for x in batches))([1, 2])
    next(stopped)
    stopped.close()
    assert len(calls) == 2


def test_language_blocks_are_small_and_change_nothing(monkeypatch):
    texts = ["Der Hund und die Katze " * (i % 50) for i in range(4000)] + [None, "", "x" * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    models = np.random.default_rng(1).normal(size=(5, langid.BINS))
    sizes, real = [], langid._trigrams
    monkeypatch.setattr(langid, "_trigrams", lambda b: sizes.append((len(b.data), b.rows)) or real(b))
    got = pa.Table.from_batches(list(langid._score_rows(models)(iter([batch])))).to_pydict()
    assert max(n for n, rows in sizes if rows > 1) <= 1 << 18
    monkeypatch.setattr(langid, "BLOCK_BYTES", 1 << 30, raising=False)
    assert got == pa.Table.from_batches(list(langid._score_rows(models)(iter([batch])))).to_pydict()
