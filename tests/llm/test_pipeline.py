"""The pipeline's stages on rows with null, repeated and shared ids, against what must stay."""

import collections

import corpus_pipeline
from tabia.llm import latent_retrieval
from tests.llm.test_operators import prose


def test_pipeline_keeps_what_it_must(spark, tmp_path):
    item = prose(900, 40)
    rows = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, None), (6, "too short"), (None, ""),
        (None, prose(2, 80)), (None, prose(2, 80)), (4, prose(3, 80)), (4, prose(4, 80)),
        (5, prose(5, 80) + "\n" + item + "\n" + prose(6, 60)), (None, prose(7, 80) + "\n" + item),
    ]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 2 keeps its row, but all its lines are those of 1
    assert collections.Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 4: 2, None: 1}
    assert all(r["exact"] for r in got)
    assert [len(r["ids"]) for r in got if r["doc_id"] == 2] == [0]


def test_decontamination_is_fitted_on_every_passage(spark, tmp_path, monkeypatch):
    """Not on the middle of some documents: 8 windows of 64 words hold 500."""
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, fit = [], latent_retrieval.latent_space

    def spy(passages, n_terms, rank):
        seen.append(passages.count())
        return fit(passages, n_terms, rank)

    monkeypatch.setattr(latent_retrieval, "latent_space", spy)
    rows = [(k, prose(k, 500) + ("\n" + prose(900, 40) if k == 7 else "")) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(30)) - {7}
    assert seen == [1 + 29 * 8 + 9]
