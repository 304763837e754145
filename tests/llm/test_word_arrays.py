import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyvine.llm.common import gathered
from tallyvine.llm.range_coder import decode_block, encode_block
from tallyvine.llm.token_files import read_token_files, write_token_files
from tallyvine.llm.tokens import WordIds
from tallyvine.sources.scratch import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_met_before_take_no_call_each():
    words, draw, calls = WordIds(PATH), random.Random(3), []
    texts = [" ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(200)).encode() for _ in range(20)]
    first = words.encode(texts)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        again = words.encode(texts)
    finally:
        sys.setprofile(None)
    assert again == first and len(calls) < 2000


def test_marks_after_any_letter_are_cut_off():
    words, seen = WordIds(PATH), []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain, words.tokenizer = words.tokenizer, Seen()
    text = "olé, más!! naïveté. ÷. ÷÷, é́. ó."
    assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(text).ids
    assert not any("olé" in part or "naïveté" in part for part in seen)


def test_ids_of_texts_in_a_row():
    words, plain = WordIds(PATH, 4000), Tokenizer.from_file(PATH)
    texts = pa.array(["left out", "a b.", None, "", " \t<|endoftext|>A,b <|x|> ", "x" * 70_000 + "!", "÷. ó.,b"]).slice(1)
    for _ in range(3):
        ids, cuts = words.ids_with_ends(texts, 7)
        want = [[*plain.encode(text or "", add_special_tokens=False).ids, 7] for text in texts.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == want
    assert words.encode([]) == [] and words.encode([b"", b" "]) == [b"", b""]


def test_gathered_batches_stay_within_their_bound():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * size])], names=["text"]) for size in (10, 20, 900, 30, 40, 50)]
    found = list(gathered(iter(batches), 130))
    assert [len(batch) for batch in found] == [2, 1, 2, 1]
    assert [x for batch in found for x in batch.column(0).to_pylist()] == [batch.column(0)[0].as_py() for batch in batches]


def test_blocks_are_not_shuffled_to_be_read(spark, odd_docs):
    path, setting = scratch_path(spark), "spark.sql.autoBroadcastJoinThreshold"
    write_token_files(odd_docs, path, PATH)
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = read_token_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, usual)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_blocks_keep_their_bytes():
    ids = np.arange(60_000, dtype=np.uint64) ** 2 % 997 * 49 % 49_408
    block = encode_block(ids.astype(np.uint32), 49_408)
    assert zlib.crc32(block) == 2712352327 and np.array_equal(decode_block(block), ids)
