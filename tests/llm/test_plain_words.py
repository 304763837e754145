import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyvine.llm.common import SLICE_ROWS, text_slices
from tallyvine.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    """A tokenizer that counts what is encoded by it as text."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_are_only_merged():
    words = WordIds(PATH)
    words.tokenizer = Counted(words.tokenizer)
    text = "naïve straße über the Weather weather, where!!"
    assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(text).ids
    assert not any("weather" in text or "stra" in text for text in words.tokenizer.texts)


def test_ids_are_those_of_the_library_for_letters_and_others():
    plain, words, draw = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    odd = letters + "'.,!#|<09\u0301\u0130\u0131\u0142\xaa\xba\xad\u200b\x7f\x85\xa0"
    for _ in range(60):
        alphabet = draw.choice((letters, odd))
        texts = [" ".join("".join(draw.choices(alphabet, k=draw.randint(1, 12))) for _ in range(30)) for _ in range(5)]
        for text, ids in zip(texts, words.encode([text.encode() for text in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_slices_of_long_texts_stay_short():
    for text, most in (("a", 4 * SLICE_ROWS), ("a" * 40_000, SLICE_ROWS)):
        batch = pa.RecordBatch.from_arrays([pa.array([text] * 1500)], names=["text"])
        found = [part.num_rows for part in text_slices([batch])]
        assert sum(found) == 1500 and max(found) == most
