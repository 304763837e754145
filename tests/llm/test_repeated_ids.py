"""The n-gram join where rows share an id, and its order of n-grams."""

import numpy as np

from tallyvine.llm.ngram_join import Rarity, gram_hashes, keep_one, link_documents, rarity, shingle_hashes
from tests.llm.conftest import COLUMNS, PROSE, rows_of

OTHER = "Nine grey geese crossed the frozen lake at dawn while two boys on the shore argued about whose turn it was to row"


def test_rows_of_one_id_count_each_for_itself(spark):
    texts = [(1, PROSE), (1, OTHER), (2, OTHER), (3, PROSE + " today"), (3, "a short one"), (3, None), (1, PROSE), (3, "")]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in link_documents(docs).collect())
    size, other = len(PROSE.split()) - 4, len(OTHER.split()) - 4
    want = [(1, size, 1), (1, size, 1), (1, other, 1), (2, other, 1), (3, size + 1, 1), (3, 1, 3), (3, 0, 3), (3, 0, 3)]
    assert found == sorted(want)
    kept = sorted((r.doc_id, r.text or "") for r in keep_one(docs).collect())
    assert kept == sorted([(1, PROSE), (1, OTHER), (3, "a short one"), (3, "")])


def test_columns_of_any_name_are_kept(spark):
    schema = "node string, row int, first int, doc_id long, text string, `a.b` int, gram int"
    docs = spark.createDataFrame([("n", 1, 2, 5, PROSE, 3, 4), ("m", 1, 2, 6, PROSE, 3, 4)], schema)
    assert [tuple(r) for r in keep_one(docs).collect()] == [("n", 1, 2, 5, PROSE, 3, 4)]


def test_frequent_grams_come_last_by_exact_count(spark):
    texts = [f"one two three four five {i} {i}a {i}b" for i in range(40)] + ["six seven eight nine ten"] * 25
    found = rarity(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), most=20)
    (often, less) = (shingle_hashes([t.encode()])[0] for t in ("one two three four five", "six seven eight nine ten"))
    assert set(found.grams.tolist()) == {int(often[0]), int(less[0])}
    every = np.unique(gram_hashes([t.encode() for t in texts])[0])
    rank = dict(zip(every.tolist(), found.of(every).tolist(), strict=True))
    assert rank[int(often[0])] > rank[int(less[0])] > max(r for g, r in rank.items() if g not in (int(often[0]), int(less[0])))


def test_the_order_changes_no_link(spark, monkeypatch):
    words = PROSE.split()
    texts = [(k, " ".join([*words[: k % 5], "x", *words, *[f"t{k % 7}{i}" for i in range(k % 4)]])) for k in range(60)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    want = {r.doc_id: r.component_id for r in link_documents(docs).collect()}
    none = Rarity(np.zeros(1 << 22, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    monkeypatch.setattr("tallyvine.llm.ngram_join.rarity", lambda *_: none)
    assert {r.doc_id: r.component_id for r in link_documents(docs).collect()} == want
