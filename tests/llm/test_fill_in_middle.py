"""Fill-in-the-middle forms against whole strings."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyvine.llm.fill_in_middle import digests, fill_in_middle, outputs
from tests.llm.conftest import COLUMNS, LONG, rows_of


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(docs):
    names = ["name", "part", "place", "piece", "copies", "n", "form", "output"]
    return docs.select("*", *[F.lit("x").alias(name) for name in names])


@pytest.fixture(scope="module")
def marked(spark, odd_docs):
    texts = [(20 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<", "<P", "P>", "<P<P>", "😀" * 9])]
    texts += [(i, f"text number {i} with a few words <") for i in range(100, 400)]
    return with_clashes(odd_docs.unionByName(spark.createDataFrame(rows_of(texts), COLUMNS)))


@pytest.mark.parametrize("unit", [1, 7, 32_768])
def test_forms_and_restored_texts(marked, unit):
    docs = marked if unit == 32_768 else marked.where("n_chars < 1000 or n_chars is null")
    pieces = fill_in_middle(docs, unit=unit)
    found = Counter(tuple(r) for r in digests(pieces).collect())
    wanted, texts = Counter(), Counter()
    for row in docs.select("doc_id", "text").collect():
        *facts, output = expected(row.doc_id, row.text)
        wanted[(row.doc_id, *facts, sha(output), sha(row.text or ""))] += 1
        texts[(row.doc_id, facts[1], output)] += 1
    assert found == wanted
    assert Counter(tuple(r) for r in outputs(pieces).collect()) == texts
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}


def test_pieces_stay_small_and_one_shuffle_serves_both_passes(spark):
    docs = spark.createDataFrame(rows_of([(1, LONG * 3), (2, LONG)]), COLUMNS)
    pieces = fill_in_middle(docs, unit=100)
    assert pieces.agg(F.max(F.octet_length("piece"))).first()[0] <= 103
    plan = digests(pieces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_of_one_id_are_documents_of_their_own(spark):
    texts = [(7, f"text {i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS).repartition(5)
    found = Counter((r.doc_id, r.restored_sha256) for r in digests(fill_in_middle(docs)).collect())
    assert found == Counter((i, sha(text)) for i, text in texts)


def test_renamed_columns_and_no_rows(no_docs, odd_docs):
    assert digests(fill_in_middle(no_docs)).count() == 0
    docs = odd_docs.select(F.col("doc_id").alias("place"), F.col("text").alias("piece"))
    found = digests(fill_in_middle(docs, "place", "piece"), "place")
    assert found.columns[0] == "place" and found.count() == odd_docs.count()
