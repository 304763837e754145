"""The index travels in few rows, and neither its parts nor the packets of queries change a result."""

import numpy as np
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm import topk
from tallyvine.llm.topk import build_index, document_queries, search, statistics
from tests.llm.conftest import COLUMNS, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 40) if x < 5000) + f" own{i} \x0b ÄB{i % 7}") for i in range(300)]
    return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(2).cache()


def best(index, asked, mean, **sizes):
    return sorted(map(tuple, search(index, asked, mean, k=5, **sizes).collect()))


def test_rows_of_the_index_do_not_grow_with_its_terms(docs):
    index = build_index(docs, shard_documents=100)
    # Of each shard its documents, and far fewer postings than fill a row.
    assert index.count() == 2 * index.select("shard").distinct().count()


def test_steps_lead_back_to_the_lists():
    numbers, sizes = np.array([4, 9, 2, 0, 7]), np.array([2, 0, 1, 2])
    assert topk._climbed(topk._steps(numbers, sizes), sizes).tolist() == numbers.tolist()


def test_parts_and_packets_change_no_result(docs, monkeypatch):
    index = build_index(docs, shard_documents=30)
    documents, mean = statistics(index)
    asked = document_queries(docs.where("doc_id % 4 = 0"), index, documents)
    want = best(index, asked, mean)
    assert len(want) == 75 * 5 and {row[2] for row in want if row[1] == 1} == set(range(0, 300, 4))
    assert best(index, asked, mean, packet_queries=2, group_shards=3) == want

    # The same by hand, in many small parts.
    monkeypatch.setattr(topk, "_LISTS", 3)
    monkeypatch.setattr(topk, "PART_POSTINGS", 50)
    monkeypatch.setattr(topk.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 3})())
    rows = docs.select("doc_id", "text").toArrow().to_batches()
    made = [row for batch in topk._index(to_arrow_schema(index.schema), 1000, 1 << 20)(iter(rows)) for row in batch.to_pylist()]
    assert len(made) > 50
    group = topk._Group(mean)
    group.add_documents(made[0])
    for row in made[1:]:
        group.add_postings(row)
    packets = topk._packets(asked, 20).collect()
    assert len(packets) > 2
    found = [x for row in packets for x in group.answer(row.asDict(), 5)]
    assert sorted(found) == sorted((query, document, score) for query, _, document, score in want)
