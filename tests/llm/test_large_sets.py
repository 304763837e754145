"""Large sets that share rare n-grams by chance are told apart without their whole sets."""

import numpy as np

from tallyvine.llm import ngram_join
from tests.llm.conftest import COLUMNS, rows_of


def test_unlike_large_sets_are_neither_met_often_nor_verified(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(40)]

    def text(row):
        own = [" ".join(f"r{row}y{i}z{k}" for i in range(55)) for k in range(40)]
        return " ".join(piece for k in rng.permutation(40) for piece in (own[k], passages[k]))

    texts = [text(row) for row in range(30)]
    words = texts[0].split()
    near = " ".join([*words[:1000], "changed", *words[1001:]])  # of more than 2,300 n-grams, past a vector of 1,024 bits
    checked = []

    def noted(pairs, *rest):
        checked.append(pairs.count())
        return verified(pairs, *rest)

    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", noted)
    found = ngram_join.link_documents(spark.createDataFrame(rows_of(enumerate([*texts, near])), COLUMNS)).collect()
    assert {r.doc_id: r.component_id for r in found} == {row: row for row in range(30)} | {30: 0}
    assert checked == [1, 0]


def test_long_parities_keep_every_link(spark):
    """Pairs at and just below the similarity, of sizes on both sides of each length of vector."""
    rng = np.random.default_rng(9)
    rows, linked = [], {}
    for k, size in enumerate([400, 500, 560, 620, 900, 1000, 1024, 1100, 2000, 2040, 2600]):
        for j, least in enumerate((800, 790)):
            one = rng.integers(0, 2**63, size, dtype=np.uint64)
            extra = rng.integers(0, 2**63, size * 1000 // least - size + (j > 0), dtype=np.uint64)
            pair = (2 * (2 * k + j), 2 * (2 * k + j) + 1)
            other = np.concatenate([one, extra])
            linked[pair] = 100 * len(one) >= 80 * len(other)
            for name, hashes in zip(pair, (one, other), strict=True):
                long = ngram_join._long_parity(hashes)
                rows.append((name, len(hashes), None if long is None else long.tolist()))
    sizes = {name: size for name, size, _ in rows}
    frame = ngram_join.store(spark.createDataFrame([(a, b, sizes[a], sizes[b]) for a, b in linked], "a long, b long, m long, n long"))
    parities = spark.createDataFrame([(name, long) for name, _, long in rows if long], "node long, long_parity array<long>")
    kept = {(r.a, r.b) for r in ngram_join._left(frame, parities, 80).collect()}
    assert {pair for pair, yes in linked.items() if yes} <= kept
    assert len({len(long) for _, _, long in rows if long}) >= 3


def test_counts_survive_squeezing():
    counts = np.random.default_rng(3).integers(0, 2**32, 1 << 10, dtype=np.uint64).astype(np.uint32)
    counts[: 1 << 9] %= 3
    assert (ngram_join._restored(ngram_join._squeezed(counts)) == counts).all()
