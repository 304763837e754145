"""The classifier without texts of both labels."""

import pytest

import corpus_pipeline
from tallyvine.llm import queries
from tallyvine.llm.classifier import UNLABELLED


@pytest.mark.parametrize(
    ("texts", "marks", "score"),
    [
        ([], [], None),
        ([], [(1, 1), (2, 0)], None),
        (["a b", None, "c"], [], UNLABELLED),
        (["a b", None, "c"], [(i, 1) for i in range(1, 40)], 1.0),
        (["a b", "c d", "e f", "g h"], [(i, 0) for i in range(1, 40)], 0.0),
    ],
)
def test_fit_and_pipeline_without_both_labels(spark, tmp_path, texts, marks, score):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    docs = spark.createDataFrame(rows, queries.TABLES["documents"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in marks], queries.TABLES["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.registry()["op10_quality_classifier"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows] and {r.score for r in found} == ({score} if texts else set())
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).count()
    assert kept == (len(rows) if texts and score >= queries.GOOD_FROM else 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
