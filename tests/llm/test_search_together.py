"""Many queries are answered together from one group, whose size follows its words and not the number of its shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvine.llm import topk
from tallyvine.llm.topk import Postings, build_index, document_queries, search, statistics
from tests.llm.conftest import COLUMNS, rows_of


def lists_of(rng, documents, terms, most):
    lists = [np.flatnonzero(rng.random(documents) < rng.choice([0.001, 0.01, 0.1, 0.6])) for _ in range(terms)]
    return [(d, rng.integers(0, most, len(d))) for d in lists if len(d)]


def postings_of(lists, documents, parts=None):
    sizes = np.array([len(d) for d, _ in lists])
    both = [np.concatenate(x) for x in zip(*lists, strict=True)]
    return Postings(np.arange(len(lists)), sizes, *both, np.arange(documents), parts)


def best_of(lists, asked, documents, k):
    total, met = np.zeros(documents, np.int64), np.zeros(documents, bool)
    for i in asked:
        total[lists[i][0]] += lists[i][1]
        met[lists[i][0]] = True
    order = np.lexsort((np.arange(documents), -total))
    return [(int(total[d]), int(d)) for d in order if met[d]][:k]


# Impacts of up to 2^31 are not exact in the four bytes of a matrix.
@pytest.mark.parametrize("most", [2, 1000, 1 << 24, 1 << 31])
def test_many_queries_at_once_are_exact(most, monkeypatch):
    monkeypatch.setattr(topk, "_FEWEST", 3)
    monkeypatch.setattr(topk, "_SCORE_BYTES", 1)
    rng = np.random.default_rng(most)
    lists = lists_of(rng, 3200, 80, most)
    asked = [rng.permutation(len(lists))[: rng.integers(0, 40)] for _ in range(20)]
    for parts in (None, np.array([0, 30, 31, 100])):
        found = list(postings_of(lists, 3200, parts).best_of(asked, 7))
        assert found == [best_of(lists, x, 3200, 7) for x in asked]


def test_long_lists_without_room_stay_lists(monkeypatch):
    rng = np.random.default_rng(4)
    lists = lists_of(rng, 640, 40, 1000)
    want = best_of(lists, range(len(lists)), 640, 9)
    for room in (0, 5 * 4 * 640, 1 << 20):
        monkeypatch.setattr(topk, "_MATRIX_BYTES", room)
        postings = postings_of(lists, 640)
        assert 4 * 640 * postings.matrices[0].shape[1] <= room
        assert postings.best(np.arange(len(lists)), 9) == want


@pytest.fixture(scope="module")
def docs(spark):
    """Three kinds of texts with words of their own, of very different lengths, and some without any."""
    rng = np.random.default_rng(21)
    texts = [(i, " ".join(f"k{i % 3}w{x}" for x in rng.zipf(1.2, rng.integers(0, 120)) if x < 900) + (" all" if i % 4 else "")) for i in range(1500)]
    return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3).cache()


def test_kinds_of_documents_change_no_result(docs, monkeypatch):
    index = build_index(docs, shard_documents=1000)
    documents, mean = statistics(index)
    asked = document_queries(docs.where("doc_id % 25 = 0"), index, documents)
    rows = index.orderBy("shard", F.col("terms").isNotNull()).collect()
    packets = topk._packets(asked, 20).collect()
    found = []
    for least in (1 << 30, 100):
        monkeypatch.setattr(topk, "_KIND_DOCUMENTS", least)
        group = topk._Group(mean)
        for row in rows:
            (group.add_documents if row["terms"] is None else group.add_postings)(row.asDict())
        found.append(sorted(x for packet in packets for x in group.answer(packet.asDict(), 5)))
        assert (len(group.postings.matrices) > 1) == (least == 100)
    assert found[0] == found[1] == sorted((q, d, s) for q, _, d, s in search(index, asked, mean, k=5).collect())


def test_impacts_are_reckoned_once(docs, monkeypatch):
    index = build_index(docs, shard_documents=1000)
    documents, mean = statistics(index)
    packets = topk._packets(document_queries(docs.where("doc_id % 25 = 0"), index, documents), 1000).collect()
    group = topk._Group(mean)
    for row in index.orderBy("shard", F.col("terms").isNotNull()).collect():
        (group.add_documents if row["terms"] is None else group.add_postings)(row.asDict())
    first = list(group.answer(packets[0].asDict(), 5))
    monkeypatch.setattr(topk.np, "rint", lambda x: pytest.fail("the same impacts again"))
    assert list(group.answer(packets[0].asDict(), 5)) == first


def test_small_shards_are_searched_together(spark, docs):
    """One large shard and many small ones make two groups, not one for every few shards."""
    large = spark.createDataFrame(rows_of([(10_000 + i, "word " * 3000) for i in range(30)]), COLUMNS).coalesce(1)
    index = build_index(docs.limit(40).repartition(20).unionByName(large))
    assert index.where("terms is null").count() >= 15
    documents, mean = statistics(index)
    found = search(index, document_queries(large.limit(1), index, documents), mean, group_shards=1)
    assert topk._placed(index, 1).agg(F.max("group")).first()[0] <= 1
    assert found.count() == 10


def test_words_are_those_of_split():
    texts = [b"", b" ", b"A b\tb\n\x0bC", "Ä a\x85 \x1c b ".encode(), b"b", b"x  \r\n\x0cX"]
    names, terms, owner = topk._words(texts)
    for i, text in enumerate(texts):
        assert [names[t] for t in terms[owner == i].tolist()] == text.lower().split()
    assert len(set(names)) == len(names) and topk._words([])[0] == []
