"""Every operator on odd, empty and skewed documents, against brute force."""

import hashlib
import json
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyvine.llm import queries
from tallyvine.llm.byte_bpe import decode_bpe, encode_bpe
from tallyvine.llm.classifier import fit_texts, keep_good, score_quality
from tallyvine.llm.components import components
from tallyvine.llm.ngram_join import keep_one, link_documents
from tallyvine.llm.packing import pack
from tallyvine.llm.quality_rules import judge, order_rules
from tallyvine.llm.secret_scan import redact_secrets, scan_secrets
from tallyvine.llm.substring_dedup import LEAST, remove_repeats, repeats
from tallyvine.llm.token_files import read_token_files, write_token_files
from tallyvine.llm.topk import build_index, document_queries, search, statistics
from tallyvine.llm.url_filter import RULES, judge_urls
from tallyvine.sources.scratch import scratch_path
from tests.llm.conftest import COLUMNS, PROSE, rows_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(value):
    return (value is not None, value or 0)


def texts_of(frame):
    return Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def assert_packed(rows, docs, tokenizer, window):
    want = Counter()
    for row in docs.collect():
        ids = ids_of(tokenizer, row.text, 1)
        for at in range(0, len(ids), window):
            piece = ids[at : at + window]
            want[(row.doc_id, at, len(piece), crc(piece), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def test_packing(odd_docs, no_docs, tokenizer):
    for window in (2048, 16):
        assert_packed(pack(odd_docs, VOCABULARY, window=window).collect(), odd_docs, tokenizer, window)
    assert pack(no_docs, VOCABULARY).count() == 0


def test_packing_wastes_little(documents, tokenizer):
    rows = pack(documents, VOCABULARY).collect()
    sequences = assert_packed(rows, documents, tokenizer, 2048)
    assert sum(r.length for r in rows) > 0.99 * 2048 * len(sequences)


def test_token_files(spark, odd_docs, no_docs, tokenizer):
    for docs, block in ((odd_docs, 1 << 19), (odd_docs, 3), (no_docs, 10)):
        path = scratch_path(spark)
        write_token_files(docs, path, VOCABULARY, block_ids=block)
        rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
        want = [(r.doc_id, ids_of(tokenizer, r.text, 2)) for r in docs.collect()]
        found = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
        assert sorted(map(repr, found)) == sorted(map(repr, want))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=key)
        ends = np.cumsum([0] + [r.n_tokens for r in rows]).tolist()
        assert [r.start for r in rows] == ends[:-1] and all(len(i) == r.n_tokens for (_, i), r in zip(found, rows, strict=True))


def test_token_files_query(spark, tables, documents, tokenizer):
    start, want = 0, []
    for row in documents.orderBy("doc_id").collect():
        ids = ids_of(tokenizer, row.text, 2)
        want.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    found = queries.registry()["op4_token_files"](spark, tables).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == want


def test_byte_bpe(spark, odd_docs, no_docs, tables, documents):
    import base64

    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = decode_bpe(encode_bpe(odd_docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    found = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows)
    assert found == Counter(
        (r.doc_id, tuple(own.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd_docs.collect()
    )
    assert encode_bpe(no_docs, RANKS, PATTERN).count() == 0
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.registry()["op7_byte_bpe"](spark, tables).collect():
        data = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.n_tokens == len(data) // 4 and r.ids_sha256 == hashlib.sha256(data).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, odd_docs, no_docs):
    extra = [(100 + i, t) for i, t in enumerate([PROSE + "\n" + PROSE, "a b " * 300, "🙂#| " * 40, (PROSE + "\n") * 3 + PROSE[:60]])]
    docs = odd_docs.unionByName(spark.createDataFrame(rows_of(extra), COLUMNS))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = judge(docs).collect()
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter((r.doc_id, *measures(r.text)) for r in docs.collect())
    kept = {r.doc_id: r.kept for r in found}
    assert kept[10] and not kept[5] and not kept[9] and not kept[102]
    assert not any(r.kept and r.base_failed for r in found)
    assert judge(no_docs).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = spark.range(100).cache()
    never, always = F.col("id") < 0, F.col("id") >= 0
    assert order_rules(sample, {"never": never, "always": always}) == ["always", "never"]


def test_quality_rules_stay_in_the_jvm(documents):
    plan = judge(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def judged(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = re.sub("[A-Z]+", lambda m: m[0].lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fitting = [
        (len(rule), rule, verdict)
        for verdict, rule in RULES
        for h, _, p in [rule.partition("/")]
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    ]
    if fitting:
        return host, path, *max(fitting)[1:]
    plain = host.removeprefix("www.") + path.rstrip("/")
    return host, path, None, "block" if host and plain in listed else "allow"


def test_url_filter(spark):
    urls = [None, "", "no url", "http://", "http://Example.NET/en/1", "https://a.example.com/de/x?y#z", "x://net", "x://net/"]
    urls += ["ftp://mynet/", "http://b.org/fr/", "http://b.org/fr", "http://WWW.bad.io/a//", "http://bad.io/a?q", "http://bad.io/b#://"]
    urls += [f"http://site{i}.io/p{i}" for i in range(500)] + ["http://bad.io/a"] * 50
    pages = spark.createDataFrame([(i, u, "h", None) for i, u in enumerate(urls)], "page_id int, url string, host string, possible string")
    listed = spark.createDataFrame([("https://bad.io/a",), (None,), ("junk",), ("http://site7.io/p7/",), ("http://x.net/en",)], "url string")
    plain = {"bad.io/a", "site7.io/p7", "x.net/en"}
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, listed).collect()}
    assert found == {i: judged(u, plain) for i, u in enumerate(urls)}
    nothing = judge_urls(pages.limit(0), listed.limit(0))
    assert nothing.count() == 0
    assert {r.verdict for r in judge_urls(pages.where("page_id > 20"), listed.limit(0)).collect()} == {"allow"}
    plan = judge_urls(pages, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def linked(docs):
    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    component = {doc: doc for doc in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    return {doc: (len(sets[doc]), component[doc]) for doc in sets}


def test_ngram_join(spark, odd_docs, no_docs):
    words = PROSE.split()
    chain = [(200 + k, " ".join([f"w{k}{i}" for i in range(k)] + words * 2 + [f"z{i}" for i in range(k, 9)])) for k in range(9)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows_of(chain), COLUMNS))
    rows = docs.select("doc_id", "text").collect()
    want = linked([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    found = link_documents(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert {r.component_id for r in found if r.doc_id is None} == {None}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    alone = {doc for doc, (_, component) in want.items() if doc == component}
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted([None, None, *alone], key=key)
    assert link_documents(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def test_many_near_copies_come_together(spark):
    words = [f"v{i}" for i in range(120)]
    texts = []
    for i in range(400):
        copy = list(words)
        for k in range(1 + i % 2):
            copy[(7 * i + 31 * k) % 120] = f"edit{i}-{k}"
        texts.append((i, " ".join(copy)))
    found = link_documents(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    want = linked_fast(texts)
    assert {r.doc_id: r.component_id for r in found} == want


def linked_fast(texts):
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {texts[i][0]: texts[root(i)][0] for i in range(len(sets))}


def test_components(spark):
    chain = [(i + 1, i) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | dict.fromkeys(range(100, 104), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(spark, odd_docs, no_docs):
    rng = np.random.default_rng(9)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))

    passage = prose(60)
    texts = [(i, f"{prose(80)} {passage} {prose(50)}") for i in range(300, 306)] + [(i, prose(150)) for i in range(306, 330)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows_of(texts), COLUMNS))
    by_id = dict(texts)
    found = [r for r in repeats(docs).collect() if r.doc_id >= 300]
    assert sorted(r.doc_id for r in found) == [301, 302, 303, 304, 305] and {r.first_doc for r in found} == {300}
    for r in found:
        assert r.end - r.start >= LEAST and by_id[r.doc_id][r.start : r.end] in by_id[300]
    cleaned = remove_repeats(docs)
    assert cleaned.columns == docs.columns
    after = {r.doc_id: r for r in cleaned.collect() if r.doc_id and r.doc_id >= 300}
    assert len(after) == 30 and all(after[i].text == by_id[i] for i in [300, *range(306, 330)])
    assert all(after[i].n_chars == len(after[i].text) < len(by_id[i]) for i in range(301, 306))
    kept = texts_of(cleaned)
    assert kept[(5, None)] == 1 and kept[(6, "")] == 1 and kept[(None, PROSE)] == 1 and kept[(12, PROSE)] in (0, 2)
    assert repeats(no_docs).count() == 0 and remove_repeats(no_docs).count() == 0


def test_secrets(spark, odd_docs, no_docs):
    texts = [(400, "é password=abcdef1 " + "f" * 30), (401, "sk_live_9aB3xQ7zT1mK5vW8pL2r here"), (402, "AKIA" + "Z" * 17)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows_of(texts), COLUMNS))
    found = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert (found[400].n_assign, found[400].n_hex, found[400].base) == (1, 1, "assign:2:18,hex:19:49")
    assert found[401].spans == "entropy:0:28" and found[401].base == "" and found[402].spans == "access:0:21"
    assert found[5].spans == found[10].spans == ""
    cleaned = {r.doc_id: r for r in redact_secrets(docs).collect()}
    assert cleaned[400].text == "é [SECRET] [SECRET]" and cleaned[400].n_chars == 19
    assert cleaned[10].text == PROSE and cleaned[5].text is None and len(cleaned) == docs.select("doc_id").distinct().count()
    assert scan_secrets(no_docs).count() == 0 and redact_secrets(no_docs).count() == 0


def test_classifier(spark, odd_docs, no_docs, tables, documents):
    model = fit_texts([PROSE.encode(), b"### $$$ %%% ### &&&"] * 8, [1, 0] * 8)
    assert score_quality(no_docs, model).count() == 0
    scores = score_quality(odd_docs, model).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert keep_good(odd_docs, model, 0.0).count() == odd_docs.count()
    found = {r.doc_id: r for r in queries.registry()["op10_quality_classifier"](spark, tables).collect()}
    for doc, row in found.items():
        assert row.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    held = [(found[r.doc_id].predicted, r.quality) for r in labels if found[r.doc_id].held_out]
    assert sum(p == q for p, q in held) > 0.93 * len(held)
    assert sum(p for p, q in held if q) > 0.97 * sum(q for _, q in held)


def bm25(texts, asked, k, least, most):
    words = {d: Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for d, t in texts}
    lengths = {d: sum(w.values()) for d, w in words.items()}
    mean = sum(lengths.values()) / len(words)
    df = Counter(t for w in words.values() for t in w)
    idf = {t: log((len(words) - n + 0.5) / (n + 0.5) + 1.0) for t, n in df.items() if n >= least}
    out = {}
    for q in asked:
        terms = sorted((t for t in words[q] if t in idf), key=lambda t: (-round(words[q][t] * idf[t] * 1e6), t))[:most]
        scores = {}
        for d, w in words.items():
            parts = [round(1e6 * idf[t] * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * lengths[d] / mean))) for t in terms if t in w]
            if parts:
                scores[d] = sum(parts)
        out[q] = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("shard", [2, 7, 1000])
def test_search(spark, odd_docs, no_docs, shard):
    rng = np.random.default_rng(shard)
    texts = [(600 + i, " ".join(f"t{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 300)) for i in range(120)]
    docs = odd_docs.where("doc_id is not null and doc_id <> 12").unionByName(spark.createDataFrame(rows_of(texts), COLUMNS))
    index = build_index(docs, shard_documents=shard)
    documents, mean = statistics(index)
    asked = document_queries(docs.where("doc_id % 10 = 0"), index, documents, terms=5, least_documents=2)
    found = {}
    for r in search(index, asked, mean, k=4).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.doc_id))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = bm25(rows, [d for d, _ in rows if d % 10 == 0], 4, 2, 5)
    assert found == {q: hits for q, hits in want.items() if hits}
    empty = build_index(no_docs)
    assert search(empty, document_queries(no_docs, empty, 0), 0.0).count() == 0


def test_search_with_null_and_repeated_ids(odd_docs):
    index = build_index(odd_docs, shard_documents=3)
    documents, mean = statistics(index)
    assert documents == odd_docs.count()
    asked = document_queries(odd_docs.where("doc_id = 10"), index, documents, least_documents=1)
    best = search(index, asked, mean, k=6).orderBy("rank").collect()
    assert sorted((r.doc_id for r in best[:5]), key=key) == [None, 10, 11, 12, 12] and len({r.score for r in best[:5]}) == 1


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    """Each stage does its part: the rejects, the copy, the passage and the secret are gone, the rest is packed whole."""
    rng = np.random.default_rng(11)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))

    good = {i: prose(120) for i in range(40)}
    passage = prose(70)
    good[40], good[41] = prose(90) + " " + passage, passage + " " + prose(100)
    good[42] = good[0]
    good[43] = prose(60) + " password=hunter22 " + prose(40)
    bad = {i: " ".join(rng.choice(["###", "$$$x", "&&&", "%%%q"], 90)) for i in range(100, 140)}
    texts = list((good | bad).items())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], queries.TABLES["documents"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i, _ in texts], queries.TABLES["labels"])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path)).cache()
        stages[name] = frame
    names = list(stages)
    texts_at = [{r.doc_id: r.text for r in stages[name].collect()} for name in names[:4]]
    assert set(texts_at[0]) == set(good) and set(texts_at[1]) == set(good) - {42}
    assert texts_at[2][40] == good[40] and len(texts_at[2][41]) < len(good[41]) - LEAST
    assert {d: t for d, t in texts_at[2].items() if d != 41} == {d: t for d, t in good.items() if d not in (41, 42)}
    assert "hunter22" not in texts_at[3][43] and "[SECRET]" in texts_at[3][43]
    assert all(stages[name].columns == docs.columns for name in names[:4])
    whole = {r.doc_id: r.n for r in frame.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert whole == {r.doc_id: r.doc_tokens for r in frame.collect()} and set(whole) == set(texts_at[3])
    assert json.dumps(sorted(whole))


def test_search_query_takes_every_term(spark, tmp_path):
    """Also terms in one document only, and more than 16 of them; a table of two documents finds both."""
    rng = np.random.default_rng(13)
    texts = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 200) if x < 5000)) for i in range(1, 120)]
    for n, rows in enumerate((texts, [(50, "alone here"), (51, "here")])):
        made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], queries.TABLES["documents"])
        made.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = {}
        for r in queries.registry()["op1_top_k_search"](spark, f"{tmp_path}/{n}").orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.score, r.doc_id))
        assert found == bm25(rows, [i for i, _ in rows if i % 50 == 0], 10, 1, None)
