"""op5: a block gets the logs of the symbols that it asks for, and no others."""

import random

import numpy as np
import pyarrow as pa

from tabia.llm import context_tree as ctw

ROOT = (np.full(31, 0.25), np.full(31, 0.5), np.full(31, 0.5))


def test_an_answer_holds_only_the_asked_symbols_and_gives_the_same_logs():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Rent", "é", "zz9", "ab"]) for _ in range(30)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array([False] * len(texts)), pa.array(texts)],
        names=["part", "doc_id", "held_out", "text"],
    )
    (asks,) = ctw.block_asks([batch], True)
    rows = [r for r in asks.to_pylist() if r["kind"] != "w"]
    rng.shuffle(rows)
    ones = np.random.default_rng(1).uniform(0.01, 0.99, (len(rows), 31)).astype("<f4")
    # a context in three is not in the tree
    tree = [(r["kind"], r["key"], ones[k].tobytes()) for k, r in enumerate(rows) if k % 3]
    table = pa.RecordBatch.from_arrays(
        [pa.array([t[0] for t in tree]), pa.array([t[1] for t in tree], pa.binary()), pa.array([t[2] for t in tree], pa.binary())],
        names=["kind", "key", "ones"],
    )
    (full,) = ctw.logs_of([table], ROOT)
    logs = {(r["kind"], r["key"]): r["logs"] for r in full.to_pylist()}
    joined = pa.RecordBatch.from_arrays(
        [
            pa.array([7] * (len(rows) + 1), pa.int64()),
            pa.array(["w", *(r["kind"] for r in rows)]),
            pa.array([b"word", *(r["key"] for r in rows)], pa.binary()),
            pa.array([4, *(r["mask"] for r in rows)], pa.int64()),
            pa.array([None, *(logs.get((r["kind"], r["key"])) for r in rows)], pa.binary()),
        ],
        names=["block", "kind", "key", "n", "logs"],
    )
    found = pa.Table.from_batches(ctw.chosen([joined.slice(0, 100), joined.slice(100)]))
    answers = found.to_pylist()
    assert [(r["key"], r["n"], r["logs"]) for r in answers if r["kind"] == "w"] == [(b"word", 4, None)]
    answers = [r for r in answers if r["kind"] != "w"]
    assert {(r["kind"], r["key"]) for r in answers} == set(logs)
    assert all(len(r["logs"]) == 4 * r["n"].bit_count() < 4 * 32 for r in answers)
    # the depth-5 masks are the (context, symbol) pairs of the texts, and no more
    pairs = {int(k) for data, _ in ctw.chunks(ctw.stream(t)[1] for t in texts) for k in ctw.keys(data)[0]}
    assert sum(r["mask"].bit_count() for r in rows if r["kind"] == str(ctw.DEPTH)) == len(pairs)
    streams = [ctw.stream(t)[1] for t in texts]
    dense, picked = ctw.Contexts.read(tree, ROOT), ctw.Contexts.read_arrow(found, ROOT)
    for data, starts in ctw.chunks(streams, 500):
        keys, mask = ctw.keys(data)[0], ctw.coded(len(data), starts)
        assert np.array_equal(dense.logs(keys)[mask], picked.logs(keys)[mask])


def test_rows_trained_on_ask_for_the_longest_contexts_only():
    texts = {"rent zz9": False, "ab ab": True, "é": None}
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 3, pa.int64()), pa.array(range(3), pa.int64()), pa.array(list(texts.values())), pa.array(list(texts))],
        names=["part", "doc_id", "held_out", "text"],
    )
    (asks,) = ctw.block_asks([batch], True, True)
    found = {(r["kind"], r["key"]) for r in asks.to_pylist()}
    assert len(found) == len(asks)
    wanted = {("w", w) for t in texts for w in ctw.stream(t)[0]}
    for text, held in texts.items():
        for data, _ in ctw.chunks([ctw.stream(text)[1]]):
            for c in (ctw.keys(data)[0][ctw.DEPTH :] >> ctw.LOW_BITS).tolist():
                for depth in [ctw.DEPTH] if held is False else range(1, ctw.DEPTH + 1):
                    wanted.add((str(depth), (c >> ctw.LOW_BITS * (ctw.DEPTH - depth)).to_bytes(4, "big")))
    # what is left are contexts at the padding
    assert wanted <= found
    assert ("3", wanted_key(b"ent")) not in found and ("3", wanted_key(b"ab ")) in found


def wanted_key(text: bytes) -> bytes:
    number = 0
    for byte in reversed(text):  # the last byte on top
        number = number << ctw.LOW_BITS | byte & 31
    return number.to_bytes(4, "big")
