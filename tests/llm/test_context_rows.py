"""op5: the rows that a block asks for, made without an object for each context."""

import random

import numpy as np
import pyarrow as pa

from tabia.llm import context_tree as ctw


def test_numbers_become_an_arrow_array_of_their_bytes():
    for numbers in (np.zeros(0, np.int32), np.array([0, 1, 255, 256, (1 << 30) - 1], np.int32)):
        assert ctw.packed_array(numbers).to_pylist() == ctw.packed(numbers)


def test_a_block_asks_for_its_words_and_its_contexts_of_every_depth():
    rng = random.Random(3)
    texts = ["", "a"] + [" ".join(rng.choice(["Rent", "é", "zz9", "\n\t"]) for _ in range(40)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array([False] * len(texts)), pa.array(texts)],
        names=["part", "doc_id", "held_out", "text"],
    )
    for with_contexts in (False, True):
        (found,) = ctw.block_asks([batch], with_contexts)
        rows = list(zip(*(found.column(c).to_pylist() for c in ("block", "kind", "key"))))
        wanted = {(7 << 32, "w", w) for text in texts for w in ctw.stream(text)[0]}
        if with_contexts:
            for data, _ in ctw.chunks(ctw.stream(text)[1] for text in texts):
                for c in (ctw.keys(data)[0] >> ctw.LOW_BITS).tolist():
                    for depth in range(1, ctw.DEPTH + 1):
                        name = (c >> ctw.LOW_BITS * (ctw.DEPTH - depth)).to_bytes(4, "big")
                        wanted.add((7 << 32, str(depth), name))
        assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_asking_sorts_contexts_instead_of_hashing_them(monkeypatch):
    for numbers in (np.zeros(0, np.int32), np.array([5, 1, 5, (1 << 30) - 1, 0, 1], np.int32)):
        assert ctw.distinct(numbers).tolist() == sorted(set(numbers.tolist()))
    texts = ["rent paid", "rent due", "zz"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 3, pa.int64()), pa.array(range(3), pa.int64()), pa.array([True, False, None]), pa.array(texts)],
        names=["part", "doc_id", "held_out", "text"],
    )
    for name in ("unique", "union1d"):
        monkeypatch.setattr(np, name, lambda *_, **__: 1 / 0)
    (found,) = ctw.block_asks([batch], True, True)
    rows = list(zip(found.column("kind").to_pylist(), found.column("key").to_pylist()))
    assert len(rows) == len(set(rows)) and {k for k, _ in rows} == {"w", "1", "2", "3", "4", "5"}


def test_the_asks_are_not_sorted_for_their_answers(spark):
    rows = [(k, f"rent paid {k % 5}", k % 7 == 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    found = ctw.context_tree_scores(docs, broadcast_contexts=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.count() == len(rows)
