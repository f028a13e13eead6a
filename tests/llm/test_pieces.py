"""op3: digests in compiled code, and the vectorised pass against the search by queue."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tabia.llm import nbest_pieces as pieces


def test_the_digests_need_no_function_over_the_segmentations(spark, tmp_path):
    docs = [(1, "the cat sat on the mat"), (2, ""), (3, None), (4, "漢字 😀 ▁x")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.op3_nbest_pieces(spark, str(tmp_path))
    assert "transform(segmentations" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: r for r in found.collect()}
    vocabulary = pieces.load()
    for key, text in docs:
        best, scores, every = pieces.encoded([text or ""], vocabulary)
        digests = [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in every.to_pylist()[0]]
        assert rows[key]["segmentations_sha256"] == digests
        assert rows[key]["ids_sha256"] == digests[0] == hashlib.sha256(" ".join(map(str, best.to_pylist()[0])).encode()).hexdigest()
        assert rows[key]["scores"] == scores[0] and rows[key]["exact"]


def test_the_vectorised_pass_equals_the_queue():
    vocabulary = pieces.load()
    rng = random.Random(5)
    letters = "etaoinsh rd漢é😀" + pieces.MARK
    for size in (1, 2, 5, 13, 32):
        chunks = sorted({"".join(rng.choice(letters.replace(" ", "")) for _ in range(size)) for _ in range(40)})
        score, loss, _ = pieces.short_segments(chunks, vocabulary)
        for k, chunk in enumerate(chunks):
            two = pieces.n_best(chunk, vocabulary, 2)
            assert math.isclose(score[k], two[0][0], rel_tol=1e-12)
            assert math.isclose(loss[k], two[0][0] - two[1][0], abs_tol=1e-9) if len(two) > 1 else np.isinf(loss[k])
        _, _, flat, offsets = pieces.segmented(chunks, vocabulary)
        for k, chunk in enumerate(chunks):
            best = pieces.n_best(chunk, vocabulary, 1)[0][1]
            assert flat[offsets[k] : offsets[k + 1]].tolist() == [i for p in best for i in vocabulary.spelled(p)]


def test_a_slice_leaves_in_small_batches_and_is_cut_in_groups(monkeypatch):
    vocabulary = pieces.load()
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshrd", k=6)) for _ in range(60)) for _ in range(60)] + [""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    whole = pieces.encoded(texts, vocabulary)
    sizes = []
    short_segments = pieces.short_segments
    monkeypatch.setattr(pieces, "short_segments", lambda chunks, v: sizes.append(len(chunks)) or short_segments(chunks, v))
    monkeypatch.setattr(pieces, "GROUP", 100)
    monkeypatch.setattr(pieces, "OUT", 2000)
    found = list(pieces.encode_batches(iter([batch]), vocabulary, pieces.BEST))
    # a row has about 420 characters
    assert max(x.num_rows for x in found) <= 5 and max(sizes) == 100
    rows = pa.Table.from_batches(found).to_pydict()
    assert rows["doc_id"] == list(range(len(texts))) and all(rows["exact"])
    assert rows["ids"] == whole[0].to_pylist()
    assert rows["scores"] == whole[1]
    assert rows["segmentations"] == whole[2].to_pylist()
