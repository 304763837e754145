from tallyvine.llm import bloom, ngram_join
from tallyvine.sources.scratch import store


def test_rows_without_a_key(spark):
    frame = spark.createDataFrame([(k, f"t{k}") for k in [*range(2000), None, 7]], "k long, t string")
    keys = store(spark.range(0, 2000, 3).withColumnRenamed("id", "other"))
    found = sorted((-1 if row.k is None else row.k) for row in bloom.without(frame, "k", keys, "other").collect())
    assert found == sorted([-1, 7, *[k for k in range(2000) if k % 3]])
    assert bloom.without(frame, "k", keys.where("other < 0"), "other").count() == 2002


def test_only_copies_are_sought_by_a_join_and_one_row_of_a_class_stays(spark, monkeypatch):
    """The prefixes of rows that stand alone are not shuffled to tell them from copies."""
    seen = []

    def noted(frame, key, keys, other):
        seen.append((frame.count(), keys.count()))
        return without(frame, key, keys, other)

    without = bloom.without
    monkeypatch.setattr(bloom, "without", noted)
    texts = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(30)]
    rows = [(k, text) for k, text in enumerate(texts)] + [(100, texts[3]), (101, texts[3].upper()), (3, texts[3]), (102, None), (None, texts[4])]
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    linked = sorted((row.doc_id, row.component_id) for row in found.collect() if row.doc_id is not None)
    assert linked == sorted([(k, k) for k in range(30)] + [(3, 3), (100, 3), (101, 3), (102, 102)])
    assert seen == [(33, 3)]
