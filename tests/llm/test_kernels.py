"""The helpers that run inside tasks, against brute force."""

import base64
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvine.llm.byte_bpe import ByteBPE
from tallyvine.llm.classifier import fit_texts, scorer
from tallyvine.llm.common import Memory
from tallyvine.llm.ngram_join import shingle_hashes
from tallyvine.llm.packing import BestFit
from tallyvine.llm.range_coder import decode_block, encode_block
from tallyvine.llm.secret_scan import base_spans, entropy_spans, highest_entropy, redact
from tallyvine.llm.substring_dedup import LONGEST, SHORTEST, cuts, without_spans
from tallyvine.llm.tokens import WordIds
from tallyvine.llm.topk import Postings


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for size in (1, 2, 7, 64, 100):
        lengths = sorted((rng.randint(1, size) for _ in range(400)), reverse=True)
        fit, free = BestFit(size), []
        for length in lengths:
            window, offset = fit.place(length)
            fitting = [left for left in free if left >= length]
            if fitting:
                assert free[window] == min(fitting)
            else:
                assert window == len(free)
                free.append(size)
            assert offset == size - free[window]
            free[window] -= length


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
@pytest.mark.parametrize("vocabulary", [1, 3, 300, 49_408])
def test_blocks_give_back_their_ids(n, vocabulary):
    ids = (np.random.default_rng(n).zipf(1.3, n) % vocabulary).astype(np.uint32)
    assert decode_block(encode_block(ids, vocabulary)).tolist() == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49_407), max_size=600))
def test_any_ids_survive(ids):
    assert decode_block(encode_block(np.array(ids, np.uint32), 49_408)).tolist() == ids


def test_damaged_blocks_are_refused():
    block = encode_block(np.arange(3000, dtype=np.uint32) % 50, 49_408)
    for at in (0, 5, 17, len(block) // 2, len(block) - 1):
        damaged = bytearray(block)
        damaged[at] ^= 0x41
        with pytest.raises(ValueError):
            decode_block(bytes(damaged))
    for cut in (0, 10, len(block) - 4, len(block) - 1):
        with pytest.raises(ValueError):
            decode_block(block[:cut])
    with pytest.raises(ValueError):
        encode_block(np.array([50_000], np.uint32), 49_408)


def test_repeated_ids_are_coded_small():
    ids = np.tile(np.arange(500, dtype=np.uint32), 400)
    assert len(encode_block(ids, 49_408)) < len(ids) / 2


def test_a_memory_keeps_what_recurs():
    memory = Memory(100 * Memory.ENTRY)
    for i in range(1000):
        memory.put(i, "x", 0)
        if "hot" not in memory.young and memory.recall("hot", 0) is None:
            assert i == 0
            memory.put("hot", "y", 0)
    assert len(memory.young) + len(memory.old) <= 102 and (memory.young | memory.old)["hot"] == "y"
    assert memory.recall(0, 0) is None


def test_small_memories_change_no_ids():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij'.,!É😀 ", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    small, large = WordIds(path, 4000), WordIds(path)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tight, roomy = (ByteBPE(ranks, public_tokenizers.PATTERN, size) for size in (8000, 1 << 24))
    for at in range(0, 60, 5):
        part = texts[at : at + 5]
        assert small.encode([t.encode() for t in part]) == large.encode([t.encode() for t in part])
        assert [tight.encode(t) for t in part] == [roomy.encode(t) for t in part]
    assert len(small.memory.young) < 40 and len(tight.units.young) < 40


def test_words_encode_as_whole_texts():
    coder = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "  a\u0085b c \x1c d", "Hello, WORLD's!! <|endoftext|> a<|ENDOFTEXT|>B<|endoftext|>", "x,.!# ***. İst ſ é é Å", "'s a.'s b,'t"]
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ByteBPE(path, public_tokenizers.PATTERN), own


def assert_encodes(bpe, text):
    ids = bpe[0].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == bpe[1].encode_ordinary(text)
    assert bpe[0].decode(ids) == text.encode()


def test_bpe_on_odd_texts(bpe):
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "中", "😀", "\x1c", "\x85", "　", ".", "ing", " t", "er", "​"]
    rng = random.Random(2)
    for _ in range(3000):
        assert_encodes(bpe, "".join(rng.choices(parts, k=rng.randrange(12))))
    for _ in range(3000):
        assert_encodes(bpe, "".join(rng.choices("aeinrstoh", k=rng.randrange(40))))
    for code in range(0x3100):
        assert_encodes(bpe, f"a {chr(code)} b{chr(code)} {chr(code)}")
    assert_encodes(bpe, "ab" * 20_000)


def test_bpe_with_other_ranks(tmp_path):
    """Merges of random order over two letters reach every kind of border."""
    rng = random.Random(3)
    for number in range(30):
        tokens = [bytes([i]) for i in range(256)]
        while len(tokens) < 290:
            # As in training: a pair that stands side by side in a text encoded so far.
            known = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
            ids = known.encode_ordinary("".join(rng.choices("ab", k=60)))
            at = rng.randrange(len(ids) - 1)
            pair = tokens[ids[at]] + tokens[ids[at + 1]]
            if pair not in tokens and len(pair) < 12:
                tokens.append(pair)
        path = tmp_path / f"{number}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        ours = ByteBPE(str(path), public_tokenizers.PATTERN)
        own = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
        )
        for _ in range(200):
            text = "".join(rng.choices("ab", k=rng.randrange(1, 30)))
            assert np.frombuffer(ours.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_chunks_cover_the_text_and_keep_characters_whole():
    rng = random.Random(4)
    for text in ["", "a", "é" * 1000, "x" * 5000, "".join(rng.choices("abc é中\n", k=4000))]:
        data = text.encode()
        ends = cuts(np.frombuffer(data, np.uint8)).tolist()
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] if data else not ends)
        sizes = np.diff([0, *ends])
        assert all(size <= LONGEST for size in sizes) and all(size >= SHORTEST - 3 for size in sizes[:-1])
        for a, b in zip([0, *ends], ends, strict=False):
            data[a:b].decode()


def test_chunks_meet_again_after_an_insertion():
    text = " ".join(random.Random(5).choices(["alpha", "beta", "gamma", "delta", "rho", "tau"], k=800)).encode()
    pieces = [set(), set()]
    for found, data in zip(pieces, (text, b"something new " + text), strict=True):
        ends = cuts(np.frombuffer(data, np.uint8)).tolist()
        found.update(data[a:b] for a, b in zip([0, *ends], ends, strict=False))
    assert len(pieces[0] - pieces[1]) <= 3


def test_spans_are_cut_out():
    assert without_spans("abcdef", [(4, 5), (1, 3)]) == "adf"
    assert without_spans("abc", [(0, 3)]) == ""


def test_entropy_of_windows():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choices("abcdeF0", k=rng.randrange(1, 60)))
        size = min(20, len(text))
        slow = []
        for at in range(len(text) - size + 1):
            part = text[at : at + size]
            slow.append(-sum(part.count(c) / size * math.log2(part.count(c) / size) for c in set(part)))
        assert highest_entropy(text) == pytest.approx(max(slow))


def test_base_spans_of_fixed_examples():
    def named(text):
        return [(kind, text[a:b]) for a, kind, b in base_spans(text)]

    assert named('x PassWord = "abc123-x" y') == [(0, 'PassWord = "abc123-x')]
    assert named("token: abc") == []
    assert named("secretoken=abcdef") == [(0, "token=abcdef")]
    assert named("secret=token=abcdef") == [(0, "secret=token=abcdef")]
    assert named("toKen=abcdef api_key:abcdefg") == [(0, "api_key:abcdefg")]
    assert named("AKIA" + "Q" * 16 + " AKIAQQ") == [(1, "AKIA" + "Q" * 16)]
    assert named("f" * 24 + " " + "f" * 23) == [(2, "f" * 24)]
    assert named("İ token=abcdef") == [(0, "token=abcdef")]
    assert base_spans("") == []


def test_entropy_finds_keys_and_leaves_prose():
    key = "sk_live_9aB3xQ7zT1mK5vW8pL2r"
    found = entropy_spans(f"use {key} here", [])
    assert [(s, e) for s, _, e in found] == [(4, 4 + len(key))]
    calm = ["123e4567-e89b-12d3-a456-426614174000", "abcabcabcabcabcabcabcabc", "internationalization-of-things", "0" * 40]
    assert entropy_spans(" ".join(calm), []) == []
    text = f"token={key}"
    assert entropy_spans(text, base_spans(text)) == []
    assert redact("a bb c", [(2, 0, 4), (3, 3, 4)], "*") == "a * c"
    assert redact("abc", [(0, 0, 3)], "*") == "*"


def test_shingles_are_sets_of_whole_word_sequences():
    texts = ["a b c d e f", "A b c d E", "a b", "a  b", "", " ", "a b c d e a b c d e"]
    sets = [set(x.tolist()) for x in shingle_hashes([t.encode() for t in texts])]
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 5]
    assert sets[1] < sets[0] and sets[2] == sets[3] and sets[1] < sets[6]
    assert not sets[2] & sets[0]


def test_classifier_learns_and_scores_empty_texts():
    rng = random.Random(8)
    good = [" ".join(rng.choices(["river", "mill", "grain", "valley", "sack"], k=60)).encode() for _ in range(40)]
    bad = [" ".join(rng.choices(["###", "$$$x", "&&&", "%%%q"], k=60)).encode() for _ in range(40)]
    texts, labels = [t for pair in zip(good, bad, strict=True) for t in pair], [1, 0] * 40
    model = fit_texts(texts[:2] + texts, labels[:2] + labels)
    scores = scorer(model)([good[0], bad[0], b""])
    assert scores[0] > 0.9 and scores[1] < 0.1 and scores[2] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        fit_texts(good, [1] * len(good))


def postings_of(lists, ranks):
    numbers, sizes = np.arange(len(lists)) * 3, np.array([len(d) for d, _ in lists], np.int64)
    documents, impacts = [np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*lists, strict=True)]
    return Postings(numbers, sizes, documents, impacts.astype(float), ranks)


def best_of(lists, ranks, k):
    total = {}
    for documents, impacts in lists:
        for document, impact in zip(documents.tolist(), impacts.tolist(), strict=True):
            total[document] = total.get(document, 0) + impact
    return sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], ranks[x[1]]))[:k]


@pytest.mark.parametrize("size", [1, 63, 64, 600, 5000])
def test_best_of_many_terms_is_exact(size):
    rng = np.random.default_rng(size)
    for n in range(60):
        lists = []
        for _ in range(rng.integers(1, 60)):
            documents = np.flatnonzero(rng.random(size) < rng.choice([0.001, 0.005, 0.2, 0.7]))
            if len(documents):
                lists.append((documents, rng.integers(0, rng.choice([2, 3, 1000]), len(documents))))
        if not lists:
            continue
        ranks = rng.permutation(size)
        asked = np.flatnonzero(rng.random(len(lists)) < 0.8)
        terms = np.sort(np.append(asked * 3, [1, 10_000]))
        assert postings_of(lists, ranks).best(terms, 5) == best_of([lists[i] for i in asked], ranks, 5), n


def test_blocks_out_of_reach_are_skipped():
    rng = np.random.default_rng(3)
    lists = [(np.arange(0, 6400, 640), np.full(10, 10**6))]
    lists += [(np.flatnonzero(rng.random(6400) < 0.3), None) for _ in range(30)]
    lists = [(d, i if i is not None else rng.integers(1, 100, len(d))) for d, i in lists]
    postings = postings_of(lists, np.arange(6400))
    assert postings.best(np.arange(31) * 3, 10) == best_of(lists, np.arange(6400), 10)
    assert postings.skipped == 190
