"""What the second pass of the n-gram join carries per posting, and that its filters lose no link."""

import numpy as np
from pyspark.sql import functions as F

from tallyvine.llm import ngram_join
from tallyvine.llm.ngram_join import link_documents
from tests.llm.conftest import COLUMNS, rows_of

SHARED = "the river ran past the old mill and the miller counted his sacks of grain before rain came".split()


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_postings_carry_short_parities_and_no_link_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [f"w{i} " + " ".join(SHARED[:10]) for i in range(12)]
    texts += [" ".join([f"v{i}", *SHARED, *SHARED[: rng.integers(1, 9)], *[f"x{i % 3}"] * rng.integers(0, 3)]) for i in range(60)]
    sets = [grams(text) for text in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            least[a] = min(least[b] for b, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y))
    tables = []
    monkeypatch.setattr(ngram_join, "store", lambda df, store=ngram_join.store: tables.append(store(df)) or tables[-1])
    found = link_documents(spark.createDataFrame(rows_of(enumerate(texts)), COLUMNS)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(least))
    carried = [t for t in tables if {"gram", "parity"} <= set(t.columns)]
    longest = [t.agg(F.max(F.size("parity"))).first()[0] for t in carried]
    assert longest and all(n is not None and n <= 4 for n in longest)
