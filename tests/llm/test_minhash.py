"""Near duplicates by tensored banding against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvine.llm.minhash import HALVES, half_keys, near_duplicates, table_postings
from tests.llm.conftest import COLUMNS, PROSE, rows_of

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    groups = list(range(len(rows)))

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    real = [i for i, (doc_id, _) in enumerate(rows) if doc_id is not None and sets[i]]
    for at, i in enumerate(real):
        for j in real[:at]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                groups[root(i)] = root(j)
    least = {}
    for i in real:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    components = [least[root(i)] if i in set(real) else doc_id for i, (doc_id, _) in enumerate(rows)]
    return Counter((doc_id, len(s), c, doc_id is not None and doc_id == c) for (doc_id, _), s, c in zip(rows, sets, components))


def found_in(docs):
    return Counter(tuple(r) for r in near_duplicates(docs).collect())


def test_odd_documents(odd_docs):
    names = ["node", "key", "row", "halves", "parity", "size", "least", "component", "kept", "n_shingles"]
    docs = odd_docs.select("*", *[F.lit(0).alias(name) for name in names])
    assert found_in(docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(80)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1] + " end"), (3, texts[0] + " end"), (1, texts[2]), (4, texts[3]), (4, texts[3])]
    found = found_in(spark.createDataFrame(rows_of(rows), COLUMNS))
    assert found == brute(rows)
    assert {r[2] for r in found if r[0] in (2, 3)} == {1}


def chains(seed, groups=25):
    """Copies of copies: each differs from the one before by a few words."""
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            rows.append((number, " ".join(words)))
            number += 1
            words = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_copies(spark, seed):
    rows = chains(seed)
    assert found_in(spark.createDataFrame(rows_of(rows), COLUMNS).repartition(4)) == brute(rows)


def test_a_hot_group_of_near_and_exact_copies(spark):
    rng = random.Random(9)
    words = PROSE.split() * 3
    rows = [(i, PROSE) for i in range(300)]
    for i in range(300, 420):
        changed = list(words)
        changed[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(changed)))
    rows += [(i, f"{PROSE} and then {' '.join(str(rng.random()) for _ in range(60))}") for i in range(420, 480)]
    assert found_in(spark.createDataFrame(rows_of(rows), COLUMNS)) == brute(rows)


def test_similar_sets_meet_in_a_table():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        common, one, two = (rng.integers(0, 2**64, size, dtype=np.uint64) for size in (160, 20, 20))
        keys = half_keys([np.append(common, one), np.append(common, two)])
        same = keys[0] == keys[1]
        missed += not (same[:HALVES].any() and same[HALVES:].any())
    assert missed == 0


def test_tables_are_formed_of_shared_half_keys_only(spark):
    sets = [[1, 2, 3, 4], [1, 2, 3, 4, 5], *[[10 * i + k for k in range(4)] for i in range(2, 60)]]
    keys = half_keys([np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]).view(np.int64)
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(keys)], "node bigint, halves array<bigint>")
    assert {r.node for r in table_postings(nodes).select("node").distinct().collect()} == {0, 1}
